from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewell.llm import neighbours as nn


def brute(ids, x, query, k=10):
    d = nn.exact(x[query], x)
    keep = [i for i in range(len(ids)) if ids[i] != ids[query]]
    return [(int(ids[i]), d[i]) for i in sorted(keep, key=lambda i: (d[i], ids[i]))[:k]]


def test_beam_search_beats_greedy_codes():
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 16)).astype(np.float32)
    aq = nn.AdditiveQuantiser.fit(x, books=4, words=16)

    def error(beam):
        codes, norms = aq.encode(x, beam)
        y = aq.books[np.arange(4), codes].sum(1)
        assert np.allclose((y**2).sum(1), norms, atol=1e-3)
        return ((x - y) ** 2).sum(1).mean()

    assert error(8) < error(1) < (x**2).sum(1).mean()


def test_looked_up_distances_are_those_of_the_sums():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 8)).astype(np.float32)
    aq = nn.AdditiveQuantiser.fit(x, books=3, words=16)
    codes, norms = aq.encode(x)
    t = aq.tables(x[:5])
    y = aq.books[np.arange(3), codes].sum(1)
    for i in range(5):
        near = norms - 2 * t[i][np.arange(3), codes].sum(1) + (x[i] ** 2).sum()
        assert np.allclose(near, ((y - x[i]) ** 2).sum(1), atol=1e-3)


def test_recall_and_order(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float32)
    got = {}
    for r in nn.op6_additive_quantisation(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        want = brute(ids, x, i)
        mine = got[int(ids[i])]
        assert len(mine) == 10 and mine == sorted(mine, key=lambda p: (p[1], p[0]))
        hit += len({v for v, _ in mine} & {v for v, _ in want})
        total += 10
        place = {int(v): k for k, v in enumerate(ids)}
        assert all(abs(s - nn.exact(x[i], x[[place[v]]])[0]) < 1e-12 for v, s in mine)
    assert hit / total >= 0.95


def test_edges(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (100, [1.0, 0.0]), (None, [1.0, 1.0]), (10, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in nn.search(df, df.where("vec_id % 100 = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 10, 0.0), (3, 2, 0.1)]
    assert nn.search(df.limit(0), df.limit(0)).count() == 0


def test_groups_of_copies_are_exact(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 8)).astype(np.float32)
    x[:1000] = x[0]  # a third is equal, and a third nearly so
    x[1000:2000] = x[1000] + r.normal(size=(1000, 8)).astype(np.float32) * np.float32(1e-4)
    ids = r.permutation(3000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    asked = ids[[0, 7, 500, 1000, 1001, 1500, 2500]].tolist()
    got = {}
    for row in nn.search(df, df.where(df.vec_id.isin(asked))).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    place = {int(v): k for k, v in enumerate(ids)}
    assert got == {int(q): [v for v, _ in brute(ids, x, place[q])] for q in asked}


def test_doubles_are_ranked_as_doubles(spark):
    base = [1.0, 2.0, 3.0]
    rows = [(k, [1.0 + (k % 13) * 1e-12, 2.0, 3.0 + (k // 13) * 1e-11]) for k in range(1, 90)] + [(0, base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nn.search(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    far = lambda v: float(np.sqrt(((np.array(v) - np.array(base)) ** 2).sum()))
    want = sorted((far(v), k) for k, v in rows if k)[:10]
    assert [k for k, _ in got] == [k for _, k in want] and [s for _, s in got] == [d for d, _ in want]


def test_clashing_columns_and_their_types_change_nothing(spark):
    r = np.random.default_rng(8)
    rows = [(int(k), r.normal(size=4).astype(np.float32).tolist()) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    odd = df
    for name, value in {"query_id": "x", "rank": "y", "score": "z", "id": 1, "_id": 2, "codes": None, "norm": [1.0], "v": "w", "h": 0, "label": 3}.items():
        odd = odd.withColumn(name, F.array(F.lit(1.0)) if isinstance(value, list) else F.lit(value))
    key = lambda d: sorted(tuple(x)[:4] for x in nn.search(d, d.where("vec_id % 20 = 0")).select("query_id", "rank", "vec_id", "score").collect())
    assert key(odd.repartition(3)) == key(df) and len(key(df)) == 30
