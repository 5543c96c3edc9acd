"""Pages of a table in one read, whatever their number."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell import catalog
from tidewell.sources import jdbc


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_all_pages_of_a_table_are_one_read(spark, tmp_path):
    spark.range(1000).select((F.col("id") * 7 % 1000).alias("s_suppkey"), F.lit("x").alias("s_name"), F.lit(1.5).alias("s_acctbal")).repartition(5).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalog.queries()["keyset_pages"](spark, str(tmp_path))
    assert plan(got).count("FileScan") == 1
    assert sorted(map(tuple, got.collect())) == [(k, "x", k // 40) for k in range(1000)]


def test_a_page_is_a_range_of_the_key(spark, tmp_path):
    df = spark.range(105).select(F.when(F.col("id") < 104, F.format_string("k%03d", "id")).alias("k"), "id").repartition(6)
    pages = list(jdbc.keyset(df, "k", 10))
    assert [sorted(r.id for r in p.collect()) for p in pages] == [list(range(k, min(k + 10, 105))) for k in range(0, 105, 10)]
    assert not any(word in plan(p) for p in pages for word in ("Limit", "TakeOrdered", "Sort"))
    assert [p.count() for p in jdbc.keyset(df.where("k IS NULL"), "k", 10)] == [1]


@pytest.mark.parametrize("parts", [1, 7])
def test_places_run_through_all_ranges(spark, parts):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = jdbc.paged(spark.range(500).select((-F.col("id")).alias("id")), "id", 3, page="nth")
        assert sorted(map(tuple, got.collect())) == [(k - 499, k // 3) for k in range(500)]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert jdbc.paged(spark.range(0), "id", 3).count() == 0
    for bad in ({"size": 0}, {"page": "id"}):
        with pytest.raises(ValueError):
            jdbc.paged(spark.range(1), "id", **bad)
