from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewell.llm import common, token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(3, "Hello  World.\nDon't stop"), (1, ""), (2, None), (7, "naïve café ﬁ ½ x\x01y <|endoftext|> z"), (7, "again"), (9, "word " * 5000), (None, "no id")]


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def test_round_trip_in_id_order(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, n_tokens string")
    manifest = tf.write_shards(docs, PATH, common.shared_dir(spark, "t"))
    rows = sorted(tf.read_shards(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 2, 3, 7, 7, 9]
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    by_id = {r.doc_id: np.frombuffer(r.tokens, "<u4").tolist() for r in rows if r.doc_id not in (7,)}
    assert all(by_id[i] == library(t) for i, t in TEXTS if i != 7)
    assert sorted(np.frombuffer(r.tokens, "<u4").tolist() for r in rows if r.doc_id == 7) == sorted(library(t) for i, t in TEXTS if i == 7)
    some = tf.read_shards(manifest, wanted=[9]).collect()
    assert [(r.doc_id, r.n_tokens) for r in some] == [(9, len(library(TEXTS[5][1])))]
    digest = tf.digests(tf.read_shards(manifest)).where("doc_id = 3").first()
    assert digest.ids_crc32 == zlib.crc32(np.array(library(TEXTS[0][1]), "<u4").tobytes())


def test_any_text_as_the_library():
    r, make, lib = random.Random(6), tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    some = ["Don't", "I'LL,", "x's.", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "e\u0301.", "ÇA***", "3.5,", "a_b_", "...", "\u00a0", "\t", "İ.", "ǅ,", "ΑΣ.", "ΑΣ b", "日本。", "ﬁ!", "«où»", "\x01", "ß?", "µ,", "it's'", "_.", "\r\n", "\x85", "a\u0300b", "word", "The", "'S", "😀.", "ª.", "aº!"]
    texts = ["".join(r.choice(some) + r.choice([" ", " ", "\n", ""]) for _ in range(r.randint(0, 12))) for _ in range(4000)]
    for lo in range(0, len(texts), 500):
        got = [np.frombuffer(x, make.dtype).tolist() for x in make.encode(texts[lo : lo + 500])]
        assert got == [x.ids for x in lib.encode_batch(texts[lo : lo + 500], add_special_tokens=False)]
    assert make.tell


def test_a_full_memo_loses_nothing():
    make, lib = tf.WordEncoder(PATH), Tokenizer.from_file(PATH)
    make.memo.most = 40
    for k in range(9):
        texts = [" ".join(f"word{k * 7 + j} the" for j in range(20)), "of the and"]
        assert [np.frombuffer(x, make.dtype).tolist() for x in make.encode(texts)] == [x.ids for x in lib.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read_shards(tf.write_shards(docs, PATH, common.shared_dir(spark, "t"))).count() == 0


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def _shard():
    out, kept = io.BytesIO(), {}
    out.close = lambda: kept.update(data=out.getvalue())
    w = tf.ShardWriter(out)
    for k in range(5):
        w.add(k, np.arange(k, dtype="<u2").tobytes())
    w.close()
    return kept["data"]


def test_frames_are_read_alone_and_checked():
    data = _shard()
    r = tf.ShardReader(_File(data))
    assert [r.tokens(k).tolist() for k in (4, 0, 2)] == [[0, 1, 2, 3], [], [0, 1]]
    assert r.counts().tolist() == [0, 1, 2, 3, 4]
    bad = bytearray(data)
    bad[int(r.offsets[3]) + 9] ^= 0xFF
    with pytest.raises(Exception):
        tf.ShardReader(_File(bytes(bad))).tokens(3)
    assert tf.ShardReader(_File(bytes(bad))).tokens(4).tolist() == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        tf.ShardReader(_File(data[:-4] + b"abcd"))


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in tf.op1_token_files(spark, sf_dir).collect()}
    docs = sorted(common.table(spark, sf_dir, "documents").select("doc_id", "text").collect())
    at = 0
    for d in docs:
        ids = library(d.text)
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (at, len(ids), tf.crc32_of(ids))
        at += len(ids)
