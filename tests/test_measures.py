"""Sketches, footers, marks in a database, and what telemetry tells of Spark's own work."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import sketches
from tidewell.plans import jdbc_upsert, sinks, telemetry
from tidewell.sources import files
from tidewell.streaming import bookmarks


def test_sketches_of_increments_are_those_of_all_rows(spark):
    df = spark.range(60_000).select((F.col("id") % 2).alias("k"), (F.col("id") % 20_011).alias("user"), F.sin("id").alias("v"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("t"), "id")
    parts = [sketches.sketched(df.where(w), "k", distinct=["user", "t"], quantiles=["v"]) for w in ("id < 10000", "id = 10000", "id > 10000")]
    got = {r.k: r for r in sketches.estimates(sketches.merged("k", *parts), {"median": 0.5, "p90": 0.9}).collect()}
    for k in (0, 1):
        rows = df.where(F.col("k") == k)
        want = rows.agg(F.count("*").alias("n"), F.count_distinct("user").alias("u"), F.count_distinct("t").alias("t"), F.collect_list("v").alias("v")).first()
        assert got[k].rows == want.n and abs(got[k].user_nunique / want.u - 1) < 0.02 and abs(got[k].t_nunique / want.t - 1) < 0.02
        v = np.sort(want.v)
        for title, q in (("median", 0.5), ("p90", 0.9)):
            assert abs(np.searchsorted(v, got[k][f"v_{title}"]) / len(v) - q) < 0.01
    none = sketches.estimates(sketches.sketched(df.where("k = 0").withColumn("v", F.lit(None).cast("double")), "k", quantiles=["v"])).first()
    assert none.v_median is None and sketches.estimates(sketches.sketched(df.limit(0), "k", distinct=["user"])).count() == 0


def test_bounds_from_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(k, k / 2, f"p{k % 3}", None if k < 5 else dt.date(2024, 1, 1 + k), None if k % 3 else k) for k in range(20)], "id long, v double, p string, day date, third int")
    sinks.ParquetSink(spark, path, ["p"]).write(df.coalesce(1))
    got = files.footer_bounds(spark, path, ["id", "v", "day"])
    assert got == files.Footers(20, {"id": (0, 19), "v": (0.0, 9.5), "day": (dt.date(2024, 1, 6), dt.date(2024, 1, 20))}, True)
    assert files.footer_bounds(spark, path, ["third"]) == files.Footers(20, {"third": (0, 18)}, False)  # files without a value
    assert files.footer_bounds(spark, path, ["id"], where="p = 'p1'") == files.Footers(7, {"id": (1, 19)}, True)
    filtered = files.footer_bounds(spark, path, ["id"], where="v > 3")
    assert filtered == files.Footers(13, {"id": (7, 19)}, False)
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_marks_in_a_database(spark):
    store = jdbc_upsert.JdbcStore(spark, "jdbc:derby:memory:marks;create=true")
    assert store.read("a") is None
    for value in (0, 7, "it's", None):
        store.write("a", value)
        assert store.read("a") == value
    store.write("b", dt.datetime(2024, 1, 2, 3))
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, h),) for h in range(8)], "ts timestamp_ntz")
    found = bookmarks.load(lambda m: df.where("ts > TIMESTAMP_NTZ '2024-01-02 03:00:00'") if m else df, "ts", store, "b")
    assert found.previous == dt.datetime(2024, 1, 2, 3) and store.read("b") == "2024-01-02 07:00:00" and store.read("a") is None


@pytest.fixture
def provider():
    own = telemetry.InMemory()
    before = telemetry.use(own)
    yield own
    telemetry.use(before)


def test_measures_of_a_load(spark, provider, tmp_path):
    path = str(tmp_path / "in")
    spark.range(1000).write.parquet(path)
    with telemetry.measured(spark, "copy", table="in"):
        spark.read.parquet(path).repartition(3).write.parquet(str(tmp_path / "out"))
    spark.read.parquet(path).count()  # not within
    assert provider.counts["copy.rows_read"] == 1000 == provider.counts["copy.rows_written"]
    assert provider.counts["copy.bytes_read"] > 0 and provider.counts["copy.shuffle_bytes"] > 0 and provider.counts["copy.spilled_bytes"] == 0
    assert [(n, t) for n, _, t in provider.spans if n == "copy"] == [("copy", {"table": "in"})]
    with pytest.raises(ValueError), telemetry.measured(spark, "broken"):
        raise ValueError
    assert provider.counts["broken.tasks"] == 0 and spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_measures_of_a_stream(spark, provider, tmp_path):
    listener = telemetry.StreamListener()
    spark.streams.addListener(listener)
    try:
        spark.range(50).write.parquet(str(tmp_path / "in"))
        bookmarks.replay(spark, str(tmp_path / "in"), spark.range(0).schema, str(tmp_path / "out"), str(tmp_path / "marks"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    assert provider.counts["stream.rows"] == 50 and provider.counts["stream.batches"] >= 1 and provider.counts["stream.started"] == 1
