from __future__ import annotations

import random
import time

import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = tc.PieceCounter(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab er th▁\n\t 's!09é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_as_the_library(text):
    assert OWN.count([text]) == [len(LIB.encode(text))]


def test_long_texts():
    texts = ["a" * 4000, " " * 500 + "x", "ab" * 1000, "the cat " * 3000, "日本語" * 300, "</s><s>"]
    assert OWN.count(texts) == [len(x) for x in LIB.encode(texts)]


def test_long_pre_tokens_take_linear_time():
    r = random.Random(8)
    some = ["".join(r.choice("abcdefgh ijéthen▁"[: r.randint(3, 17)]) for _ in range(r.randint(100, 3000))) for _ in range(60)]
    some += ["".join(r.choice("etaoinshr日") for _ in range(5000)), "th" * 2000, "\n" * 700, "e" * 1001]
    assert OWN.count(some) == [len(x) for x in LIB.encode(some)]
    for text in ("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000)), "a" * 1_000_000, " " * 1_000_000, "é日" * 300_000):
        start = time.process_time()
        assert OWN.count([text])[0] > 0
        assert time.process_time() - start < 10


def test_query_and_edges(spark, sf_dir):
    got = {r.doc_id: r for r in tc.op9_token_counts(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n = len(LIB.encode(d.text))
        assert tuple(got[d.doc_id])[1:4] == (len(d.text.encode()), n, n > 4096)
    docs = spark.createDataFrame([(1, None, 1), (1, "", 2), (2, "b", 3)], "doc_id long, text string, n_tokens int")
    assert sorted(tuple(r) for r in tc.count_tokens(docs, PATH).collect()) == [(1, 0, 0, False), (1, 0, 0, False), (2, 1, 1, False)]
    assert tc.count_tokens(docs.limit(0), PATH).count() == 0
