"""Exact distinct counts of increments."""

from __future__ import annotations

import datetime as dt

from oracle import of_spark
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.operators import sketches


def test_many_distinct_values_are_counted_exactly(spark, tmp_path):
    day = F.when(F.col("id") % 11 == 0, None).otherwise(F.when(F.col("id") % 2 == 0, dt.datetime(1995, 1, 1)).otherwise(dt.datetime(1996, 1, 1))).cast("timestamp_ntz")
    keys = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, "A").otherwise("N").alias("l_returnflag"), F.when(F.col("id") % 1000 != 7, F.col("id") * 7919 % 50_021).alias("l_partkey"), F.lit(1.0).alias("l_quantity"), day.alias("l_shipdate"))
    keys.write.parquet(f"{tmp_path}/lineitem.parquet")
    want = keys.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.countDistinct("l_partkey").alias("l_partkey_nunique"))
    assert of_spark(catalog.queries()["group_nunique_incremental"](spark, str(tmp_path))) == of_spark(want)


def test_tallies_of_parts_add_up(spark):
    rows = [(None, "a"), (1, None), (1, "a"), (1, "b"), (2, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    part = sketches.tallied(df, "k", "v")
    got = sketches.exact(sketches.added("k", "v", part, part, part.limit(0)), ["k"], "v")
    assert {tuple(r) for r in got.collect()} == {(None, 2, 1), (1, 6, 2), (2, 2, 0)}
