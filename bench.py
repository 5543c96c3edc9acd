"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` is the tables' folder and ``BENCH_CPUS`` the cores. Each query
is run once to warm up and then timed as the median of three, with its rows
forced through a sink that drops them.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from tidewell import catalog
from tidewell.plans.gateway import Gateway
from tidewell.plans.sinks import ParquetSink
from tidewell.session import session
from tidewell.sources.files import ParquetSource
from tidewell.sources.jdbc import DRIVERS, JdbcSource

HEADLINE = (
    "flagship",
    "filter_in",
    "filter_or",
    "large_in",
    "rename_field_map",
    "group_sum",
    "group_nunique",
    "dedup_last",
    "left_join",
    "semi_join",
    "anti_join",
    "union_hybrid",
    "vec_topk",
    "topk",
    "derived_column",
    "sink_roundtrip_parquet",
    "incr_delta",
    "upsert_merge",
)


def _events(spark, sf_dir):
    return Gateway(spark, ParquetSource(f"{sf_dir}/lineitem.parquet")), ["l_orderkey", "l_shipdate", "l_suppkey", "l_extendedprice", "l_returnflag"]


def to_pandas(spark, sf_dir):
    """Five columns of the largest table as pandas."""
    g, columns = _events(spark, sf_dir)
    return len(g.load(columns=columns, return_type="pandas"))


def in_to_pandas(spark, sf_dir):
    """The rows of 25 of many keys as pandas."""
    g, columns = _events(spark, sf_dir)
    return len(g.load(columns=columns, l_suppkey__in=list(range(1, 26)), return_type="pandas"))


def batches(spark, sf_dir):
    """The same columns as Arrow batches of 100,000 rows."""
    g, columns = _events(spark, sf_dir)
    return sum(b.num_rows for b in g.iter_batches(100_000, columns=columns))


ROWS_100K: list = []


def sink_100k(spark, sf_dir):
    """100,000 rows that are in memory, as those of the baseline, to a Parquet dataset, partitioned and swapped in."""
    if not ROWS_100K:
        df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_suppkey", "l_extendedprice", "l_returnflag")
        ROWS_100K.append(df.limit(100_000).repartition(4).persist())
        ROWS_100K[0].count()
    return len(ParquetSink(spark, "/tmp/tidewell-bench/sink", ["l_returnflag"]).write(ROWS_100K[0]).files)


DATABASE: list[str] = []


def _database(spark, sf_dir):
    """Orders in a database in the driver's memory, written once, before the clock runs."""
    if not DATABASE:
        url = "jdbc:derby:memory:bench;create=true"
        spark.read.parquet(f"{sf_dir}/orders.parquet").drop("o_orderdate").coalesce(1).write.format("jdbc").options(url=url, dbtable="orders", driver=DRIVERS["jdbc:derby"], batchsize=10_000).save()
        DATABASE.append(url)
    return DATABASE[0]


def sql_to_pandas(spark, sf_dir):
    """All orders of a database as pandas, in one fetch."""
    return len(Gateway(spark, JdbcSource(_database(spark, sf_dir), table="orders")).load(return_type="pandas"))


def sql_partitioned(spark, sf_dir):
    """The same in ranges of the key, 8 connections at a time."""
    source = JdbcSource(_database(spark, sf_dir), table="orders", partition_column="o_orderkey", chunk=20_000, workers=8)
    return len(Gateway(spark, source).load(return_type="pandas"))


ACTIONS = {"sql_to_pandas": sql_to_pandas, "sql_partitioned_8": sql_partitioned, "parquet_to_pandas": to_pandas, "in_clause_to_pandas": in_to_pandas, "stream_batches": batches, "sink_write_100k": sink_100k}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g", "spark.sql.execution.arrow.maxRecordsPerBatch": "100000", "spark.sql.warehouse.dir": "/tmp/tidewell-bench/warehouse"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    for name, action in ACTIONS.items():
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            action(spark, sf_dir)
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
