"""Loads past a mark, dataset records, upserts, streams into sinks: what must not be lost or doubled."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.plans import jdbc_upsert, sinks
from tidewell.plans.gateway import Gateway
from tidewell.sources import files, hadoop, jdbc, partitioned_cube
from tidewell.streaming import batches, bookmarks


def data(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def gate(spark):
    rows = [(k, k % 14, f"u{k % 3}") for k in range(1000)]
    return Gateway(spark, spark.createDataFrame(rows, "event_id long, u long, name string"))


@pytest.mark.parametrize("mark", [None, 0, 500, 998, 999, 5000])
def test_marks_beside_exclusions_and_own_filters(gate, mark):
    past = [k for k in range(1000) if mark is None or k > mark]
    store = bookmarks.MemoryStore({} if mark is None else {"e": mark})
    load = lambda *a, **kw: sorted(r.event_id for r in gate.load(*a, watermark_store=bookmarks.MemoryStore(dict(store.values)), watermark_source="e", since="event_id", **kw).collect())
    assert load({"u": 0}, exclude=True) == [k for k in past if k % 14]
    assert load({"$or": [{"u": 0}, {"u": 1}]}) == [k for k in past if k % 14 < 2]
    assert load(event_id__gt=800) == [k for k in past if k > 800]
    assert load({"event_id__gt": 100}, u=3) == [k for k in past if k > 100 and k % 14 == 3]
    got = gate.load_incremental("event_id", bookmarks.MemoryStore(dict(store.values)), "e", filters={"u": 0}, exclude=True)
    assert got.frame.count() == len([k for k in past if k % 14])
    got = gate.load_incremental("event_id", bookmarks.MemoryStore(dict(store.values)), "e", event_id__gt=800, columns=["name"])
    assert got.frame.columns == ["name"] and got.frame.count() == len([k for k in past if k > 800])
    excluding = Gateway(gate.spark, gate.source, exclude=True)
    assert excluding.load_incremental("event_id", bookmarks.MemoryStore(dict(store.values)), "e", u=0).frame.count() == len([k for k in past if k % 14])


def test_limits_shaping_and_columns_past_a_mark(gate):
    store = bookmarks.MemoryStore({})
    with pytest.raises(ValueError):
        gate.load(since="event_id", watermark_store=store, watermark_source="e", limit=10, df_options={"sort_field": [("event_id", "descending")]})
    with pytest.raises(ValueError):
        gate.load_incremental("event_id", store, "e", limit=10)
    assert store.values == {}
    assert "Filter" in gate.load(since="event_id", watermark_store=store, watermark_source="e", u=1, dry_run=True) and store.values == {}
    got = gate.load(since="event_id", watermark_store=store, watermark_source="e", columns=["u", "name"], df_options={"group_by_expr": "u", "group_expr": "count"})
    assert store.values == {"e": 999} and got.count() == 14
    assert gate.load(since="event_id", watermark_store=store, watermark_source="e", columns=["u"]).count() == 0


def test_pipeline_past_a_mark_without_its_column(spark, gate, tmp_path):
    store, sink = bookmarks.MemoryStore({"e": 900}), sinks.ParquetSink(spark, str(tmp_path / "out"))
    job = sinks.ParquetPipeline(gate, sink)
    assert job.incremental("event_id", store, "e", columns=["u"], event_id__lt=950).frame.columns == ["u"] and store.values == {"e": 949}
    with pytest.raises(ValueError):
        job.incremental("event_id", store, "e", limit=5)
    assert job.incremental("event_id", store, "e", columns=["u"]).frame.count() == 99


# ------------------------------------------------------------------- records
def test_partition_types_survive(spark, tmp_path):
    path = str(tmp_path / "typed")
    df = spark.createDataFrame([(1, "01", dt.date(2024, 1, 2)), (2, "x", None), (3, None, dt.date(2024, 1, 3))], "id int, code string, day date")
    df = sinks.with_partition_date(df, "day").drop("day")
    sink = sinks.UpsertSink(spark, path, ["id"], ["code", "partition_date"])
    sink.write(df)
    assert data(files.read_dataset(spark, path).select(*df.columns)) == data(df)
    sink.write(df.where("id = 1").withColumn("partition_date", F.lit("2024-02-01")))
    sink.write(spark.createDataFrame([(4, "007", "x")], df.schema))
    want = sorted([(1, "01", "2024-02-01"), (2, "x", None), (3, None, "2024-01-03"), (4, "007", "x")], key=repr)
    assert data(files.ParquetSource(path).read(spark).select(*df.columns)) == want
    job = sinks.ParquetPipeline(Gateway(spark, df), sinks.ParquetSink(spark, str(tmp_path / "again"), ["code"]))
    assert dict(job.materialize().frame.dtypes)["code"] == "string"
    # a dataset without a record, as something else wrote it: the new rows' types count
    other = str(tmp_path / "other")
    df.write.partitionBy("code").parquet(other)
    sinks.UpsertSink(spark, other, ["id"], ["code"]).write(df.where("id = 1").withColumn("partition_date", F.lit("new")))
    assert sorted(r.code or "" for r in files.read_dataset(spark, other).collect()) == ["", "01", "x"]


def test_upserts_by_partition_keys_leave_other_folders_unread(spark, tmp_path):
    path = str(tmp_path / "keys")
    df = spark.createDataFrame([(k, f"p{k % 4}", "old") for k in range(40)], "id int, p string, v string")
    sink = sinks.UpsertSink(spark, path, ["id", "p"], ["p"])
    sink.write(df)
    before = {f for f in hadoop.listed(spark, path, ".parquet") if "p=p1" not in f}
    sink.write(df.where("id = 5").withColumn("v", F.lit("new")))
    assert before <= set(hadoop.listed(spark, path, ".parquet"))
    assert data(files.read_dataset(spark, path).where("v = 'new'").select("id", "p")) == [(5, "p1")] and files.read_dataset(spark, path).count() == 40


def test_appends_read_new_footers_only(spark, tmp_path, monkeypatch):
    path, asked, real = str(tmp_path / "many"), [], files._schemas
    monkeypatch.setattr(files, "_schemas", lambda s, names: asked.extend(names) or real(s, names))
    sink = sinks.ParquetSink(spark, path, ["p"])
    df = spark.createDataFrame([(k, k % 3) for k in range(30)], "id int, p int")
    sink.write(df)
    for _ in range(3):
        sink.write(df, overwrite=False)
    assert asked == []
    df.withColumn("id", F.col("id").cast("long")).where("p = 0").drop("p").coalesce(1).write.mode("append").parquet(f"{path}/p=0")  # by something else
    sink.write(df.withColumn("note", F.lit("x")), overwrite=False)
    assert len(asked) == 1
    with pytest.raises(sinks.SchemaNarrowingError):
        sink.write(df.withColumn("note", F.lit(1)), overwrite=False)
    got = files.read_dataset(spark, path)
    assert dict(got.dtypes) == {"id": "bigint", "note": "string", "p": "int"} and got.count() == 160


# ------------------------------------------------------------------ databases
def derby(spark, name, rows):
    sink = jdbc_upsert.JdbcUpsertSink(spark, f"jdbc:derby:memory:{name};create=true", "items", ["id"], workers=3)
    with sink._connection() as c:
        c.createStatement().executeUpdate('CREATE TABLE items ("id" BIGINT PRIMARY KEY, "name" VARCHAR(20), "qty" INT)')
    if rows:
        sink.write(spark.createDataFrame(rows, "id long, name string, qty int"))
    return sink


def stored(spark, sink):
    return data(jdbc.JdbcSource(sink.url, table="items").read(spark))


def staged(spark, sink):
    tables = jdbc.JdbcSource(sink.url, query="select tablename from sys.systables where tabletype = 'T'").read(spark)
    return [r[0] for r in tables.collect() if "STAGED" in r[0]]


def test_database_upserts(spark, monkeypatch):
    sink = derby(spark, "upserts", [(k, f"n{k}", k) for k in range(50)])
    rows = spark.createDataFrame([(k, f"m{k}", "extra") for k in range(40, 60)], "ID long, name string, other string").withColumnRenamed("ID", "id").repartition(5)
    sink.write(rows)
    assert stored(spark, sink) == sorted([(k, f"n{k}", k) for k in range(40)] + [(k, f"m{k}", k if k < 50 else None) for k in range(40, 60)], key=repr)
    before = stored(spark, sink)
    broken = rows.withColumn("name", F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="lost"):
        sink.write(broken)
    with pytest.raises(ValueError, match="one key"):
        sink.write(rows.unionByName(rows.withColumn("name", F.lit("z"))))
    with pytest.raises(KeyError):
        sink.write(rows.drop("id"))
    with pytest.raises(Exception):  # noqa: B017 - the database's own error, in the merge
        sink.write(rows.withColumn("id", F.when(F.col("id") == 45, None).otherwise(F.col("id"))))
    assert stored(spark, sink) == before and staged(spark, sink) == []
    # a task that is run again after it had committed
    real, runs = jdbc_upsert.JdbcUpsertSink._stage, []

    def twice(self, df, stage):
        runs.append(stage)
        real(self, df, stage)
        if len(runs) == 1:
            real(self, df.limit(3), stage)

    monkeypatch.setattr(jdbc_upsert.JdbcUpsertSink, "_stage", twice)
    sink.write(rows.withColumn("name", F.lit("again")))
    assert len(runs) == 2 and len(stored(spark, sink)) == 60 and staged(spark, sink) == []


def test_merge_statements():
    text = jdbc_upsert.merge_statement("jdbc:postgresql://h/d", "t", "s", ["k"], ["v"])
    assert text == "INSERT INTO t (k, v) SELECT k, v FROM s WHERE 1 = 1 ON CONFLICT (k) DO UPDATE SET v = excluded.v"
    assert jdbc_upsert.merge_statement("jdbc:sqlite:x", "t", "s", ["k"], []).endswith("DO NOTHING")
    assert "ON DUPLICATE KEY UPDATE v = VALUES(v)" in jdbc_upsert.merge_statement("jdbc:mysql://h", "t", "s", ["k"], ["v"])
    with pytest.raises(ValueError):
        jdbc_upsert.merge_statement("jdbc:clickhouse://h", "t", "s", ["k"], ["v"])


def test_text_ranges(spark):
    keys = ["", "it's", "B", "a", "b", "é"] + [f"zz{k:05d}" for k in range(3000)] + ["same"] * 500
    url = "jdbc:derby:memory:texts;create=true"
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "code string, n int")
    df.write.format("jdbc").options(url=url, dbtable="codes", driver=jdbc.DRIVERS["jdbc:derby"], createTableColumnTypes="code VARCHAR(20)").save()
    # Spark's writer can't put null into such a column of this database
    with jdbc_upsert.JdbcUpsertSink(spark, url, "codes", ["code"])._connection() as c:
        c.createStatement().executeUpdate(f'INSERT INTO codes ("n") VALUES ({len(keys)})')
    keys.append(None)
    source = jdbc.JdbcSource(url, table="codes", partition_column="code", chunk=400, workers=16)
    got = source.read(spark)
    assert sorted(r.n for r in got.collect()) == list(range(len(keys)))
    sizes = [len(p) for p in got.rdd.glom().collect()]
    assert len(sizes) >= 7 and max(sizes) <= 2 * 500 and sorted(sizes)[len(sizes) // 2] >= 200
    assert jdbc.JdbcSource(url, table="codes", partition_column="code", chunk=10_000).read(spark).count() == len(keys)
    assert jdbc.text_predicates("c", []) == ["1 = 1"] and jdbc.text_predicates("c", ["it's"]) == ["c < 'it''s' OR c IS NULL", "c >= 'it''s'"]


def test_cubes_that_executors_read(spark):
    import pyarrow as pa

    def load(part, filters):
        rows = [k for k in range(part * 10, part * 10 + 10) if k >= filters.get("k__gte", 0)]
        yield pa.table({"k": pa.array(rows, pa.int64()), "asked": pa.array([repr(sorted(filters))] * len(rows)), "more": pa.array([1] * len(rows))})

    cube = partitioned_cube.PartitionedCube("k long, asked string", lambda f: [p for p in range(6) if p * 10 + 9 >= f.get("k__gte", 0)], load, ["k"])
    df = Gateway(spark, cube).load(k__gte=25, asked__ne="x")
    assert sorted(r.k for r in df.collect()) == list(range(25, 60)) and {r.asked for r in df.collect()} == {"['k__gte']"}
    assert df.rdd.getNumPartitions() == 4 and "LocalTableScan" not in df._jdf.queryExecution().toString()
    assert Gateway(spark, cube).load({"$or": [{"k": 3}, {"k": 58}]}).count() == 2


# -------------------------------------------------------------------- streams
def test_repeated_batches_change_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "appended")
    rows = [spark.createDataFrame([(k, b, f"p{k % 2}") for k in range(b * 10, b * 10 + 10)], "id int, b int, p string") for b in range(3)]
    sink = lambda: batches.BatchSink(sinks.ParquetSink(spark, path, ["p"]), "s1")
    first = sink()
    for b in (0, 1):
        first(rows[b], b)
    first(rows[1], 1)  # handed over again by the same run
    sink()(rows[0], 0)  # and by another
    assert data(files.read_dataset(spark, path).select("id", "b", "p")) == data(rows[0].unionByName(rows[1]))
    # lost after files were moved in, before the batch was recorded
    real = hadoop.write_text
    monkeypatch.setattr(batches.hadoop, "write_text", lambda s, p, t: (_ for _ in ()).throw(OSError("lost")) if p.endswith(batches.BATCHES) else real(s, p, t))
    with pytest.raises(OSError):
        sink()(rows[2], 2)
    monkeypatch.setattr(batches.hadoop, "write_text", real)
    assert sink().written() == {"s1": 1}
    sink()(rows[2], 2)
    assert files.read_dataset(spark, path).count() == 30 and sink().written() == {"s1": 2}
    assert batches.BatchSink(sinks.ParquetSink(spark, path, ["p"]), "s2").written() == {"s1": 2}
    upsert = batches.BatchSink(sinks.UpsertSink(spark, str(tmp_path / "kept"), ["p"]), "u", order=["id"])
    for b in (0, 1, 1, 0):
        upsert(rows[b], b)
    assert data(files.read_dataset(spark, str(tmp_path / "kept")).select("id", "p")) == [(18, "p0"), (19, "p1")]


def test_late_rows_and_repeats_of_a_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    schema = "id long, k string, ts timestamp"
    loads = [[(1, "a", at(0)), (1, "a", at(1)), (2, "a", at(20)), (3, "b", at(500))], [(4, "a", at(1)), (5, "b", at(520))], [(6, "c", at(3000))]]
    sink = batches.BatchSink(sinks.ParquetSink(spark, str(tmp_path / "out")), "s")
    for rows in loads:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = batches.once(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", ["id"], "30 minutes")
        batches.stream_into(batches.sessions(stream, "ts", ["k"], "30 minutes"), sink, str(tmp_path / "marks"))
    got = {(r.k, r.start, r.n) for r in files.read_dataset(spark, str(tmp_path / "out")).collect()}
    assert got == {("a", at(0), 2), ("b", at(500), 2)}  # row 4 came after its time had passed
