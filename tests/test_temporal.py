"""Joins in time and of hot keys, and neighbours of many vectors, against loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import vectors
from tidewell.operators import joins, temporal


def data(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("strict, tolerance", [(False, None), (True, None), (False, "3 hours")])
def test_asof_against_loops(spark, strict, tolerance):
    r = random.Random(3)
    t = lambda: r.choice([None, *(dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(0, 400, 1))])
    left = [(r.choice(["hot", "hot", "hot", "b", "c", None]), n, t()) for n in range(150)]
    right = [(r.choice(["hot", "hot", "b", None]), t(), r.choice([None, 1, 2, 3]), "x") for _ in range(120)]
    want = []
    for k, n, at in left:
        fit = [x for x in right if k is not None and at is not None and x[0] == k and x[1] is not None and (x[1] < at if strict else x[1] <= at)]
        best = max(fit, key=lambda x: (x[1], x[2] is not None, x[2] or 0)) if fit else None
        if best and tolerance and at - best[1] > dt.timedelta(hours=3):
            best = None
        want.append((k, n, at, *(best[1:] if best else (None, None, None))))
    ldf, rdf = spark.createDataFrame(left, "k string, n int, at timestamp_ntz"), spark.createDataFrame(right, "k string, since timestamp_ntz, v int, w string")
    for span in (3600.0 * 5, 86_400.0 * 30):
        got = temporal.asof_join(ldf, rdf, "k", "at", "since", strict=strict, tolerance=tolerance, span=span)
        assert got.columns == ["k", "n", "at", "since", "v", "w"] and data(got) == sorted(want, key=repr)
    inner = temporal.asof_join(ldf, rdf, "k", "at", "since", strict=strict, tolerance=tolerance, how="inner")
    assert data(inner) == sorted((w for w in want if w[3] is not None), key=repr)


def test_asof_of_numbers_dates_and_no_rows(spark):
    left, right = spark.createDataFrame([(1, 5), (1, -7)], "k int, at int"), spark.createDataFrame([(1, -8, "a"), (1, 5, "b")], "k int, since int, v string")
    assert data(temporal.asof_join(left, right, "k", "at", "since", span=3)) == sorted([(1, 5, 5, "b"), (1, -7, -8, "a")], key=repr)
    assert data(temporal.asof_join(left, right.limit(0), "k", "at", "since")) == sorted([(1, 5, None, None), (1, -7, None, None)], key=repr)
    assert temporal.asof_join(left.limit(0), right, "k", "at", "since").count() == 0
    d = spark.createDataFrame([(1, dt.date(2024, 3, 1))], "k int, at date")
    assert temporal.asof_join(d, d.withColumnRenamed("at", "since"), "k", "at", "since").collect()[0].since == dt.date(2024, 3, 1)
    with pytest.raises(TypeError):
        temporal.asof_join(d, right, "k", "at", "since")
    with pytest.raises(ValueError):
        temporal.asof_join(left, right.withColumn("at", F.lit(1)), "k", "at", "since")


def test_intervals_against_loops(spark):
    r = random.Random(4)
    points = [(r.choice([1, 2, None]), n, r.choice([None, r.uniform(-50, 50)])) for n in range(80)]
    spans = [(r.choice([1, 2, None]), a := r.uniform(-60, 50), a + r.choice([0, 1, 5, 60]), n) for n in range(40)]
    p, s = spark.createDataFrame(points, "k int, n int, at double"), spark.createDataFrame(spans, "k int, a double, b double, m int")
    want = {(n, m) for k, n, at in points for j, a, b, m in spans if k is not None and k == j and at is not None and a <= at < b}
    for width in (0.7, 10.0, 1000.0):
        assert {(x.n, x.m) for x in temporal.interval_join(p, s, "at", "a", "b", on="k", span=width).collect()} == want
    want = {(n, m) for _, n, at in points for _, a, b, m in spans if at is not None and a <= at < b}
    assert {(x.n, x.m) for x in temporal.interval_join(p, s.drop("k"), "at", "a", "b", span=10.0).collect()} == want


def test_hot_keys_are_spread(spark):
    left = spark.range(12_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 500).cast("int").alias("k"), "id")
    right = spark.range(600).select(F.col("id").cast("int").alias("k"), F.concat(F.lit("v"), "id").alias("v")).unionByName(spark.createDataFrame([(7, "again"), (None, "n")], "k int, v string"))
    assert joins.hot_keys(left, "k", 0.1) == [7]
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        for c, v in zip(before, ("false", "-1", "16"), strict=True):
            spark.conf.set(c, v)
        for how in ("left", "inner"):
            got = joins.hot_key_join(left, right, "k", how=how, salt=16)
            plain = left.join(right, "k", how)
            assert sorted(map(repr, got.select("id", "k", "v").collect())) == sorted(map(repr, plain.select("id", "k", "v").collect()))
            largest = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
            assert largest(got) < largest(plain) / 2 and largest(got) < 4_000
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_many_queries_against_loops(spark, metric, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 7)
    r = np.random.default_rng(1)
    base = r.normal(size=(300, 6)).round(2)
    base[100:220] = base[100]  # copies, more than k
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(900, None), (901, [float("nan")] * 6), (902, [1.0]), (903, [])]
    df = spark.createDataFrame(rows, "i long, v array<double>").repartition(5)
    asked = [k for k in range(0, 300, 10)] + [900, 901]
    want = {}
    for q in asked[:-2]:
        s = [(float(vectors._exact(base[q : q + 1], base[k : k + 1], metric)[0]), k) for k in range(300) if k != q]
        if metric == "cosine":
            s = [x for x in s if np.isfinite(x[0])]
        want[q] = sorted(s)[:5]
    got = {}
    for x in vectors.nearest_many(df.where(F.col("i").isin(asked)), df, "v", "i", 5, metric).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.distance, x.id))
    assert got == want
    assert vectors.nearest_many(df.limit(0), df, "v", "i", 5, metric).count() == 0
