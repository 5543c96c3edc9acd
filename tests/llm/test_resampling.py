from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from oracle import connect, of_spark, of_sql
from pyspark.sql import functions as F

from tidewell.llm import resampling as rs


def plain(docs, target, longest, buckets, percent, least, seed):
    """Ranks by loops: (id, n_features, weight, score, rank)."""

    def words(text):
        return re.findall(rs.WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))

    def runs(w):
        return [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(runs(words(text)))
    for text in target:
        t.update(runs(words(text)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((n + 1) * (all_t + buckets)))) for b, n in s.items()}
    scored = []
    for i, text in docs:
        w = words(text)
        f = runs(w)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    inside = sorted((x for x in scored if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(inside[: len(inside) * percent // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in scored), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


TEXTS = ["One two three four", "TWO three Éa été two", "", None, "...!", "a-b_c 12 x9", "one " * 40, "日本 語 one\x00two"]


def test_against_loops(spark):
    docs = [(k, TEXTS[k % 8] if k % 3 else " ".join(f"w{(k * j) % 17}" for j in range(k % 40))) for k in range(120)] + [(None, "one two three four five six"), (5, "five again five again five")]
    target = ["two three", None, "w1 w2 w3 w5", "One"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("bucket", F.lit("b")).withColumn("score", F.lit(0))
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    for longest, parts in ((1, 1), (3, 5)):
        have = rs.resampled(df.repartition(parts), aims, longest=longest, buckets=101, percent=30, least_words=5)
        assert got(have) == plain(docs, target, longest, 101, 30, 5, rs.SEED)


def test_repeated_rows_have_ranks_in_turn(spark):
    docs = [(7, "same words in each of these rows")] * 30
    rows = got(rs.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame([("same",)], "text string"), percent=50, least_words=2))
    assert sorted(r[4] for r in rows if r[4] is not None) == list(range(1, 16)) and len(rows) == 30


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert got(rs.resampled(none, some)) == []
    assert got(rs.resampled(some, none, percent=100, least_words=1)) == plain([(1, "a b c")], [], 1, rs.BUCKETS, 100, 1, rs.SEED)


def test_query_agrees_with_its_sql(spark, sf_dir):
    assert of_spark(rs.op12_importance_resampling(spark, sf_dir)) == of_sql(connect(sf_dir), rs.ORACLE_SQL)
