"""Ranges of a text key: where they begin, and tables that are filled in parts."""

from __future__ import annotations

import random

from tidewell.plans import embedded
from tidewell.sources import jdbc


def test_every_chunkth_key_begins_a_range(spark):
    keys = [f"zz{k:06d}" for k in range(29_000)] + ["it's", "B", "a", "é", "Z"] + ["same"] * 1000
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k, n) for n, k in enumerate([*keys, None])], "code string, n int")
    source = embedded.source(spark, rows, "codes", '"code" VARCHAR(20), "n" INT', "code", partition_column="code", chunk=5, workers=2)
    marks = sorted(keys)[5::5]
    assert source.cuts(spark) == [k for k, before in zip(marks, [None, *marks], strict=False) if k != before]
    few = jdbc.JdbcSource(source.url, table="codes", partition_column="CODE", chunk=4_000, workers=2, options={"fetchSize": "100"}).read(spark)
    assert few.rdd.getNumPartitions() == 2 and sorted(r.n for r in few.collect()) == list(range(len(keys) + 1))


def test_a_table_in_parts(spark, monkeypatch):
    monkeypatch.setattr(embedded, "PART", 300)
    monkeypatch.setattr(embedded, "MOST_PARTS", 6)
    keys = [None, None, "", "it's", 'say "x"', "é"] + [f"zz{k:05d}" for k in range(2000)] + ["same"] * 500
    random.Random(1).shuffle(keys)
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "code string, n int").repartition(3)
    source = embedded.parted(spark, rows, "codes", '"code" VARCHAR(20), "n" INT', "code", chunk=40, workers=2)
    assert 4 <= len(source.parts) <= 6 and len({p.url for p in source.parts}) == 1
    got = source.read(spark)
    assert sorted((r.n, r.code) for r in got.collect()) == list(enumerate(keys))
    assert got.rdd.getNumPartitions() == 2
    # a key is in one part, and all parts have about as many others
    held = [{r.code for r in p.read(spark).collect()} for p in source.parts]
    assert sum(map(len, held)) == len(set(keys)) and all(held)


def test_more_partitions_than_parts(spark):
    database = embedded.Database(spark)
    rows = spark.range(70).selectExpr("lpad(cast(id as string), 3, '0') as code").repartitionByRange(7, "code")
    tables = database.load_parts(rows, "codes", '"code" VARCHAR(20)', "code", 3)
    url = database.published()
    held = [sorted(r.code for r in jdbc.JdbcSource(url, table=t).read(spark).collect()) for t in tables]
    assert len(held) == 3 and sum(held, []) == [f"{k:03d}" for k in range(70)]


def test_parts_of_no_rows(spark):
    source = embedded.parted(spark, spark.createDataFrame([], "code string, n int"), "codes", '"code" VARCHAR(20), "n" INT', "code", chunk=40)
    assert len(source.parts) == 1 and source.read(spark).collect() == []
