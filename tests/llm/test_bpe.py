from __future__ import annotations

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewell.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
OWN = bpe.ByteBPE(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    ids = OWN.encode([text])[0].tolist()
    assert ids == LIB.encode(text, add_special_tokens=False).ids
    assert OWN.decode(ids) == text


def test_marks_and_blanks_as_the_library():
    r = random.Random(12)
    some = ["Don't", "it's.", "dogs'", "I'LL,", "x's", "a.b", "É***", "ß!?", "3.5,", "a1!", "_x_", "...", "\u00a0", "\t", "\n", "  ", "\u3000", "日本。", "😀.", "\0", "ª.", "×!", "<|endoftext|>", "word", "(a)", "'s", "a'\u2019", "\x85", "\x1c"]
    texts = ["".join(r.choice(some) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randint(0, 12))) for _ in range(3000)]
    got = [x.tolist() for x in OWN.encode(texts)]
    assert got == [x.ids for x in LIB.encode_batch(texts, add_special_tokens=False)]
    values, ends = OWN.encoded(texts)
    assert OWN.decoded(values, ends) == [LIB.decode(x, skip_special_tokens=False) for x in got]


def test_long_and_special():
    for text in ("a" * 3000, "é☃" * 400, "<|endoftext|>", "x <|endoftext|>y\n\n  z ", " " * 900 + "w", ""):
        ids = OWN.encode([text])[0].tolist()
        assert ids == LIB.encode(text, add_special_tokens=False).ids
        assert OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


def test_broken_ids_decode_alike():
    r = random.Random(1)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(5)]
        assert OWN.decode(ids) == LIB.decode(ids, skip_special_tokens=False)


def test_segment_tree_root_is_the_minimum():
    r = random.Random(3)
    values = [r.randrange(1000) for _ in range(37)]
    tree = bpe.SegmentTree(list(values))
    for _ in range(200):
        k, v = r.randrange(37), r.randrange(1000)
        values[k] = v
        tree.put(k, v)
        assert tree.root == min(values)


def test_query_and_edges(spark, sf_dir):
    got = {r.doc_id: r for r in bpe.op5_bpe_round_trip(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = LIB.encode(d.text, add_special_tokens=False).ids
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()
    one = bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20), PATH)
    assert all(r.decoded == OWN.decode(r.token_ids) for r in bpe.decode(one, PATH).collect())
    docs = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (2, "b", "z")], "doc_id long, text string, token_ids string")
    rows = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs).collect())
    assert [r[:2] for r in rows] == [(1, 0), (1, 0), (2, 1)] and rows[0][2] == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(docs.limit(0)).count() == 0
