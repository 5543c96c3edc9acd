"""Databases of the driver's own process, filled by and read from executors."""

from __future__ import annotations

import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest

from tidewell.plans import embedded
from tidewell.sources import jdbc

CLUSTER = """
import sys
sys.path[:0] = [{repo!r}, {repo!r} + "/tests"]
from oracle import connect, of_spark, of_sql
from pyspark.sql import SparkSession
from tidewell import catalog
root = {root!r}
conf = {{"spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.warehouse.dir": root + "/warehouse", "spark.checkpoint.dir": "file://" + root + "/shared", "spark.sql.shuffle.partitions": "4", "spark.driver.host": "127.0.0.1"}}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
con = connect({data!r})
for name in {names!r}:
    print(name, of_spark(catalog.queries()[name](spark, {data!r})) == of_sql(con, catalog.oracle_sql()[name]))
spark.stop()
"""


def on_a_cluster(names, root, data):
    """What queries say where executors are processes of their own."""
    code = CLUSTER.format(repo=str(Path(__file__).resolve().parent.parent), root=str(root), names=names, data=data)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, timeout=600)
    return done.stdout.split("\n")[:-1], done.stderr[-3000:]


def test_ranges_and_limits_on_executors_of_their_own(sf_dir, tmp_path):
    names = ["jdbc_limit", "jdbc_partitioned", "jdbc_single_fetch", "jdbc_statement_ranges", "jdbc_text_ranges"]
    got, error = on_a_cluster(names, tmp_path, sf_dir)
    assert got == [f"{n} True" for n in names], error


def test_upserts_on_executors_of_their_own(sf_dir, tmp_path):
    got, error = on_a_cluster(["jdbc_upsert"], tmp_path, sf_dir)
    assert got == ["jdbc_upsert True"], error


def test_values_of_all_kinds(spark):
    texts = ["", " a ", 'say "x"', '"', "a,b", "two\nlines\r\nmore", "é\U0001f600", None, "NULL", "\\n", "'"]
    rows = [(n, t, None if n == 3 else n / 3, dt.datetime(2020, 1, 1, 12, 0, 0, n), dt.date(1969, 12, n + 1), n % 2 == 0, bytearray([0, n]), None) for n, t in enumerate(texts)]
    schema = "n int, t string, x double, ts timestamp, d date, b boolean, y binary, none string"
    database = embedded.Database(spark)
    database.run('CREATE TABLE kinds ("n" INT, "t" VARCHAR(100), "x" DOUBLE, "ts" TIMESTAMP, "d" DATE, "b" BOOLEAN, "y" VARCHAR(10) FOR BIT DATA, "none" VARCHAR(9))')
    df = spark.createDataFrame(rows, schema)
    database.load(df.repartition(3), "kinds")
    database.run('CREATE TABLE "Alone" ("none" VARCHAR(9))')
    database.load(df.select("none"), '"Alone"')
    url = database.published()
    assert sorted(map(tuple, jdbc.JdbcSource(url, table="kinds").read(spark).collect())) == sorted(map(tuple, df.collect()))
    assert [r[0] for r in jdbc.JdbcSource(url, table='"Alone"').read(spark).collect()] == [None] * len(texts)


def test_sources_of_no_rows(spark):
    source = embedded.source(spark, spark.range(0), "t", '"id" BIGINT', "id", partition_column="id", chunk=2)
    assert source.read(spark).count() == 0
    assert embedded.is_embedded(source.url) and not embedded.is_embedded("jdbc:derby://h:1527/db") and not embedded.is_embedded("jdbc:postgresql://h/d")


def test_a_database_that_failed_to_load_says_so(spark):
    database = embedded.Database(spark)
    database.run('CREATE TABLE t ("s" VARCHAR(2))')
    with pytest.raises(Exception, match="truncation|too long|22001"):
        database.load(spark.createDataFrame([("long",)], "s string"), "t")
    database.close()
