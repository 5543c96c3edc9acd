"""Types, shaping, joins, sources, sinks and bookmarks on literal rows."""

from __future__ import annotations

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F

from tidewell.functions import fieldmap, vectors
from tidewell.functions import filters as fl
from tidewell.functions import types as ty
from tidewell.operators import enrich, joins, shape
from tidewell.plans import checkpoints, sinks, telemetry
from tidewell.plans.gateway import Gateway, Helper
from tidewell.sources import cube, files, guard, jdbc, profiles
from tidewell.streaming import bookmarks


def data(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_coercion(spark):
    df = spark.createDataFrame([("1", "yes", "2024-01-01T00:00:00"), (" ", "0", "x"), ("3.7", "maybe", None), ("9007199254740993", "2", None)], "id string, flag string, ts string")
    got = ty.apply_schema_map(df, {"id": "Int64", "flag": "boolean", "ts": "datetime64[ns]", "gone": "int"})
    assert data(got) == sorted([(1, True, dt.datetime(2024, 1, 1)), (None, False, None), (3, None, None), (9007199254740993, True, None)], key=repr)
    ty.validate_schema(got, {"id": "Int64", "flag": "bool"})
    with pytest.raises(ty.SchemaValidationError):
        ty.validate_schema(got, {"id": "string"})
    with pytest.raises(ty.SchemaValidationError):
        ty.validate_schema(got, {"id": "Int64"}, strict=True)


def test_dedup_keeps_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1), (None, "e", None)], "k int, v string, o int")
    assert data(shape.deduplicate(df, "k", "first", "o")) == sorted([(1, "a", 1), (2, "c", 1), (None, "d", 1)], key=repr)
    assert data(shape.deduplicate(df, "k", "last", "o")) == sorted([(1, "b", 2), (2, "c", 1), (None, "e", None)], key=repr)
    assert data(shape.deduplicate(df, "k", False)) == [(2, "c", 1)]
    with pytest.raises(ValueError):
        shape.deduplicate(df, "k", "middle")


def test_group_and_select(spark):
    df = spark.createDataFrame([("x", 1, True), ("x", 2, False), (None, 5, None)], "k string, n int, b boolean")
    assert data(shape.group(df, "k", {"n": ["sum", "first"], "b": "any"}, "n")) == sorted([("x", 3, 1, True), (None, 5, 5, None)], key=repr)
    with pytest.raises(ValueError):
        shape.group(df, "k", {"n": "mode?"})
    assert shape.select_fields(df, ["n", "zz"]).columns == ["n"] and shape.select_fields(df, ["zz"]).columns == df.columns
    with pytest.raises(ValueError):
        shape.distinct_values(df, "n", 1)
    assert shape.bounded_count(df, 1) == 2


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "n")], "id long, v string")
    right = spark.createDataFrame([("1", "x"), ("3", "z"), (None, "q")], "id string, v string")
    got = joins.left_join(left, right, "id", schema={"id": "Int64"})
    assert got.columns == ["id", "v_x", "v_y"]
    assert data(got) == sorted([(1, "a", "x"), (2, "b", None), (3, "c", "z"), (None, "n", None)], key=repr)
    with pytest.raises(ty.SchemaValidationError):
        joins.left_join(left, right, "id")
    keys = spark.createDataFrame([(1,), (None,), (1,)], "k long")
    assert data(joins.semi_join(left, keys, "id")) == [(1, "a")]
    assert len(data(joins.semi_join(left, keys, "id", nulls=True))) == 2
    assert data(joins.anti_join(left, keys, "id")) == sorted([(2, "b"), (3, "c"), (None, "n")], key=repr)
    assert data(joins.anti_join(left, keys, "id", nulls=True)) == [(2, "b"), (3, "c")]
    assert "Join" in joins.left_join(left, right, "id", schema={"id": "Int64"}, dry_run=True)
    with pytest.raises(ValueError):
        joins.indexed_left_join(left, left, "id")


def test_field_map():
    with pytest.raises(ValueError):
        fieldmap.FieldMap({"a": "x", "b": "x"})
    assert fieldmap.FieldMap({"a": "x"}).columns(["x", "y"]) == ["a", "y"]


def test_gateway(spark):
    df = spark.createDataFrame([(1, 10, "Alice"), (2, 20, "Bob"), (3, 30, "Carol")], "id int, id_type int, nm string")
    g = Gateway(spark, df, field_map={"id_type": "type_id", "nm": "first_name"}, filters={"type_id__gte": 20}, allowed=["type_id", "id"])
    assert data(g.load()) == [(2, 20, "Bob"), (3, 30, "Carol")]
    assert data(g.load(type_id__gte=30)) == [(3, 30, "Carol")]
    assert g.load(return_type="arrow", columns=["first_name"]).to_pydict() == {"first_name": ["Bob", "Carol"]}
    assert list(g.load(return_type="pandas", df_options={"index_col": "id", "sort_field": [("id", "descending")]}).index) == [3, 2]
    assert [b.num_rows for b in g.iter_batches(1)] == [1, 1]
    assert g.describe()["rows"] == 2 and "Filter" in g.load(dry_run=True)
    with pytest.raises(ValueError):
        g.load(first_name="Bob")
    with pytest.raises(ValueError):
        g.load(return_type="dask")
    h = Helper(spark, df)
    assert len(h.pandas.load(id__in=[1, 2])) == 2 and h.arrow.load(limit=1).num_rows == 1
    import asyncio

    assert len(asyncio.run(g.aload(return_type="pandas"))) == 2
    assert len(h.load(return_type="auto")) == 3


def test_guard():
    assert guard.check("-- c\n /* d */ SELECT ';' AS x;") == "SELECT ';' AS x"
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT 1", "", "EXPLAIN SELECT 1"):
        with pytest.raises(guard.UnsafeSqlError):
            guard.check(bad)


def test_sources(spark, tmp_path):
    path = str(tmp_path / "d")
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, "2024-01-03")], "id long, event_date string")
    df.write.partitionBy("event_date").parquet(path)
    got = files.ParquetSource(path, start="2024-01-02", end="2024-01-03", partition_on=["event_date"]).read(spark)
    assert [r.id for r in got.orderBy("id").collect()] == [2, 3]
    assert files.ParquetSource(str(tmp_path / "none"), schema=df.schema).read(spark).count() == 0
    for day, n in (("2024/1/31", 1), ("2024/2/1", 2), ("2025/1/1", 3)):
        spark.createDataFrame([(n,)], "id long").write.parquet(str(tmp_path / "ymd" / day))
    got = files.ParquetSource(str(tmp_path / "ymd") + "/*/*/*", start="2024-01-31", end="2024-12-31").read(spark)
    assert sorted(r.id for r in got.collect()) == [1, 2]
    with pytest.raises(ValueError):
        files.ParquetSource("x", filename="../y")
    with pytest.raises(files.StaleFileError):
        files.check_age(spark, path, -1)
    env = {"DB_MAIN_URL": "jdbc:derby:x", "DB_MAIN_USER": "u"}
    assert profiles.ConnectionCatalog.from_env("DB", env).jdbc("main", table="t").options == {"user": "u"}
    with pytest.raises(ValueError):
        profiles.StorageCatalog({"s": "s3a://b"}).path("s", "../x")


def test_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(k, f"n{k}") for k in range(100)], "id int, name string")
    rows.write.format("jdbc").options(url=url, dbtable="t", driver=jdbc.DRIVERS["jdbc:derby"]).save()
    source = jdbc.JdbcSource(url, table="t", partition_column="id", chunk=30)
    assert source.read(spark).count() == 100 and source.plan(spark).partitions == 4
    assert source.read(spark).rdd.getNumPartitions() == 4
    plan = source.plan(spark)
    assert jdbc.RangePlan.from_json(plan.to_json()) == plan
    assert sum(source.read(spark).where(p).count() for p in plan.predicates()) == 100
    assert Gateway(spark, jdbc.JdbcSource(url, query='select "id", "name" from t where "id" < 5')).load(id__gte=3).count() == 2
    for bad in ({"query": "delete from t"}, {"table": "t", "workers": 99}, {"table": "t", "partition_column": "id", "limit": 3}, {}):
        with pytest.raises(ValueError):
            jdbc.JdbcSource(url, **bad)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, 1.5, "a"), (2, 2.5, "b")], "id int, amount float, p string")
    sink = sinks.ParquetSink(spark, path, ["p"])
    assert len(sink.write(df).files) == 2
    sink.write(spark.read.parquet(path).where("id = 1"))  # a dataset replaced by what is read from it
    assert spark.read.parquet(path).count() == 1
    sink.write(spark.createDataFrame([(3, 3.5, "late", "a")], "id long, amount double, note string, p string"), overwrite=False)
    got = files.read_evolved(spark, path)
    assert dict(got.dtypes)["id"] == "bigint" and got.count() == 2
    with pytest.raises(sinks.SchemaNarrowingError):
        sink.write(spark.createDataFrame([("x", "a")], "id string, p string"), overwrite=False)
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(sinks.PartitionValueError):
            sink.write(spark.createDataFrame([(1, bad)], "id int, p string"))
    with pytest.raises(ValueError):
        sinks.CsvSink(spark, path, ["a", "b"])
    assert {"csv", "jsonl", "parquet", "upsert"} <= set(sinks.available_sinks())
    up = sinks.UpsertSink(spark, str(tmp_path / "up"), ["id"])
    up.write(spark.createDataFrame([(1, "a"), (2, "b")], "id int, n string"))
    up.write(spark.createDataFrame([(2, "B"), (3, "c")], "id int, n string"))
    assert data(spark.read.parquet(str(tmp_path / "up"))) == [(1, "a"), (2, "B"), (3, "c")]
    with pytest.raises(ValueError):
        up.write(spark.createDataFrame([(2, "B"), (2, "c")], "id int, n string"))


def test_bookmarks(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "seq long, n string")
    read = lambda f: Gateway(spark, df).load(f)
    for store in (bookmarks.JsonStore(spark, str(tmp_path / "m.json")), bookmarks.TableStore(spark, str(tmp_path / "m"))):
        store.write("s", 0)
        inc = bookmarks.load(read, "seq", store, "s")
        assert (inc.previous, inc.current, inc.frame.count(), store.read("s")) == (0, 1, 1, 1)
        again = bookmarks.load(read, "seq", store, "s")
        assert not again.committed and again.frame.count() == 0 and again.current == 1
    assert bookmarks.load(lambda f: read(f).where("false"), "seq", bookmarks.MemoryStore({}), "s").current is None
    with pytest.raises(ValueError):
        bookmarks.build_filters("x", 1, "lt")


def test_checkpoints(spark, tmp_path):
    plan = checkpoints.SlicePlan.of(["id < 5", "id >= 5"])
    assert checkpoints.SlicePlan.from_json(plan.to_json()) == plan
    seen = []

    def read(s):
        seen.append(s.key)
        return spark.range(10).where(s.predicate)

    path = str(tmp_path / "c")
    assert checkpoints.run(spark, plan, read, path).count() == 10
    assert checkpoints.run(spark, plan, read, path).count() == 10 and len(seen) == 2
    assert len(checkpoints.finished(spark, plan, path)) == 2


def test_cube_hybrid_artifact(spark):
    past = spark.createDataFrame([(1, dt.date(2026, 4, 15)), (2, dt.date(2026, 4, 18))], "id int, d date")
    live = spark.createDataFrame([(10, dt.date(2026, 4, 18)), (11, dt.date(2026, 4, 20)), (12, dt.date(2026, 4, 1))], "id long, d date")
    h = cube.HybridDataset(lambda s: past, lambda s: live, "d", "2026-04-18")
    ids = lambda *a, **b: sorted(r.id for r in h.load(spark, *a, **b).collect())
    assert ids("2026-04-01", "2026-04-30") == [1, 10, 11] and ids("2026-04-01", "2026-04-16") == [1] and ids("2026-04-18", "2026-04-19") == [10]
    assert ids("2026-04-01", "2026-04-30", source="live") == [10, 11, 12]
    with pytest.raises(cube.CubeContractError):
        cube.CubeSource(lambda s, r: 1).read(spark)

    class A(cube.BaseArtifact):
        def load_frame(self, spark, params):
            return spark.createDataFrame([tuple(params.values())], "a string, b string")

    assert data(A("2026-01-01", dt.date(2026, 1, 2)).load(spark)) == [("2026-01-01", "2026-01-02")]
    with pytest.raises(ValueError):
        A("2026-01-02", "2026-01-01")


def test_enrichment(spark):
    df = spark.createDataFrame([(1, "a", "10"), (2, "b", "x")], "id int, status string, v string")
    got = enrich.Composite([enrich.TypeCaster({"v": "Int64", "zz": "int"}), enrich.DerivedColumn({"w": "v * 2", "y": "w + 1"}), enrich.RowFilter(["(id >= 1) & ~(status == 'b')"])]).transform(df)
    assert data(got) == [(1, "a", 10, 20, 21)]
    for bad in ("__import__('os')", "a.b > 1", "1; drop", "x ** 2"):
        with pytest.raises(enrich.ExpressionError):
            enrich.translate(bad)
    spec = enrich.AttachmentSpec("seg", lambda ids: [{"k": str(i), "segment": f"seg_{i}"} for i in ids], "id", "k", keyword="ids", drop=["k"])
    assert data(enrich.Enricher([spec]).transform(df).select("id", "segment")) == [(1, "seg_1"), (2, "seg_2")]
    with pytest.raises(ValueError):
        enrich.Enricher([spec], most=1).transform(df)


def test_vectors_and_telemetry(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 0.0])], "id int, v array<float>")
    assert [r.id for r in vectors.nearest(df, "v", [1.0, 0.0], 2, "l2", "id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        vectors.nearest(df, "v", [1.0], 1, "hamming")
    with pytest.raises(TypeError):
        vectors.nearest(df, "id", [1.0], 1)
    seen = telemetry.InMemory()
    before = telemetry.use(seen)
    with telemetry.span("x", a=1):
        telemetry.count("n", 2)
    telemetry.use(before)
    assert seen.spans[0][0] == "x" and seen.counts["n"] == 2


def test_llm_is_not_needed():
    import subprocess
    import sys

    code = "import sys; sys.modules['tidewell.llm'] = None; import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: None if n.startswith('tidewell.llm') else f(n, *a); import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(k.startswith('op1') for k in q)"
    from pathlib import Path

    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_long_lists_and_frames_of_values_anywhere(spark):
    rows = [(k if k % 7 else None, f"t{k % 3}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)) for k in range(6100)]
    df = spark.createDataFrame(rows, "k long, t string, ts timestamp_ntz")
    gate = Gateway(spark, df, field_map={"k": "key"})
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=j)) for j in range(6000)]
    n = lambda **f: gate.load(**f).count()
    for size in (5000, 5001, 6000):
        values = list(range(size))
        inside = sum(r[0] is not None and r[0] < size for r in rows)
        known = sum(r[0] is not None for r in rows)
        assert n(key__in=values) == inside and n(key__in=values, exclude=True) == known - inside
        assert n(key__not_in=values) == known - inside and n(key__not_in=values, exclude=True) == inside
        assert n(key__in=[*values, None]) == inside + len(rows) - known
        assert n(key__not_in=[*values, None]) == known - inside
        assert gate.load({"$or": [{"key__in": values}, {"t": "t0"}]}).count() == sum(r[0] is not None and r[0] < size or r[1] == "t0" for r in rows)
        assert gate.load({"$not": {"key__in": values, "t": "t0"}}).count() == sum(r[1] != "t0" or r[0] is not None and r[0] >= size for r in rows)
        with pytest.raises(fl.FilterError):
            Gateway(spark, df, allowed=["t"]).load(k__in=values)
    assert n(ts__date__in=days[:5000]) == n(ts__date__in=days) == len(rows)
    assert n(ts__date__in=[d.isoformat() for d in days[:5001]]) == len(rows)
    assert n(ts__year__in=[2024] * 9 + list(range(3000, 9000))) == sum(r[2].year == 2024 for r in rows)
    keys = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    assert n(key__in=keys) == 2 and n(key__in=keys, exclude=True) == n(key__not_in=keys) == sum(r[0] is not None for r in rows) - 2
    assert gate.load({"$or": [{"key__in": keys}, {"key": 5}]}).columns == ["key", "t", "ts"]
    assert fl.apply(df, k__in=keys).count() == 2


def test_since(spark, tmp_path):
    rows = [(k, f"e{k}") for k in range(1, 11)]
    spark.createDataFrame(rows, "seq long, name string").createOrReplaceTempView("since_events")
    store = bookmarks.JsonStore(spark, str(tmp_path / "wm.json"))
    gate = Gateway(spark, "since_events")
    assert len(gate.load(since="seq", watermark_store=store, return_type="pandas")) == 10 and store.read("since_events") == 10
    assert gate.load(since="seq", watermark_store=store).count() == 0
    store.write("since_events", 7)
    assert sorted(gate.load({"name__ne": "e9"}, since=("seq", store, "since_events"), return_type="pandas")["seq"]) == [8, 10]
    assert store.read("since_events") == 10
    assert gate.load(since="seq", watermark_store=store, watermark_source="x", watermark_operator="gte", watermark_initial=9).count() == 2
    with pytest.raises(ValueError):
        gate.load(since="seq")
    with pytest.raises(ValueError):
        Gateway(spark, spark.range(3)).load(since="id", watermark_store=store)
    with pytest.raises(TypeError):
        gate.load(since=3, watermark_store=store)


def test_evolved_reads_keep_folders_columns(spark, tmp_path):
    path = str(tmp_path / "evolved")
    sink = sinks.ParquetSink(spark, path, ["p"])
    sink.write(spark.createDataFrame([(1, 1.5, "a"), (2, 2.5, "b")], "id int, x float, p string"))
    sink.write(spark.createDataFrame([(3, "late", "a")], "id long, note string, p string"), overwrite=False)
    df = files.ParquetSource(path, evolved=True).read(spark)
    assert sorted(df.columns) == ["id", "note", "p", "x"]
    assert sorted((r.id, r.p) for r in df.collect()) == [(1, "a"), (2, "b"), (3, "a")]
    some = df.where("p = 'b'")
    assert [r.id for r in some.collect()] == [2] and "PartitionFilters: [isnotnull(p" in some._jdf.queryExecution().toString()


def test_pages_zones_and_marks(spark, tmp_path):
    df = spark.createDataFrame([(k, "x") for k in range(25)], "id long, n string")
    assert [[r.id for r in p.collect()] for p in Gateway(spark, df).iter_pages("id", 10)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert list(Gateway(spark, df.limit(0)).iter_pages("id", 10)) == []
    local = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12),)], "t timestamp_ntz")
    assert ty.assume_zone(local, {"t": "Europe/Madrid"}).select((F.unix_seconds("t")).alias("s")).first().s == 1719828000
    with pytest.raises(ty.SchemaValidationError):
        ty.assume_zone(df, {"id": "UTC"})
    store = bookmarks.JsonStore(spark, str(tmp_path / "m.json"))
    for v in (1, 2):
        store.write("a", v)
    assert store.read("a") == 2


def test_upserts_replace_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "up")
    up = sinks.UpsertSink(spark, path, ["id"], ["p"])
    rows = lambda r: spark.createDataFrame(r, "id int, n string, p string")
    up.write(rows([(1, "a", "x"), (2, "b", "y"), (3, "c", "z w"), (4, "d", "x"), (9, "i", None)]))
    before = {f for f in up.write(rows([(1, "a", "x")])).files}
    other = {f.name for f in (tmp_path / "up" / "p=y").iterdir() if f.suffix == ".parquet"}
    up.write(rows([(1, "A", "x"), (3, "C", "y"), (5, "e", "n/a".replace("/", "")), (9, "I", None)]))
    assert data(spark.read.parquet(path).select("id", "n", "p")) == sorted([(1, "A", "x"), (2, "b", "y"), (3, "C", "y"), (4, "d", "x"), (5, "e", "na"), (9, "I", None)], key=repr)
    assert not (tmp_path / "up" / "p=z w").exists() and before and other
    same = {f.name for f in (tmp_path / "up" / "p=y").iterdir() if f.suffix == ".parquet"}
    up.write(rows([(4, "D", "x")]))
    assert same == {f.name for f in (tmp_path / "up" / "p=y").iterdir() if f.suffix == ".parquet"}
    with pytest.raises(sinks.PartitionValueError):
        up.write(rows([(4, "D", "a/b")]))
    assert [d.name for d in tmp_path.iterdir()] == ["up"]


def test_profiles_from_files(tmp_path):
    file = tmp_path / "x.env"
    file.write_text("# c\nexport SHOP_URL='jdbc:derby:y'\nSHOP_USER=u\nOTHER=1\n")
    c = profiles.ConnectionCatalog()
    c.load("shop.main", "SHOP", env_file=str(file), env={"SHOP_USER": "v"}, fetchsize=9)
    source = c.jdbc("shop.main", table="t")
    assert source.url == "jdbc:derby:y" and dict(source.options) == {"user": "u", "fetchsize": "9"}
    for bad in ("", "a b", "a/b"):
        with pytest.raises(ValueError):
            c.register(bad, url="x")
    with pytest.raises(KeyError):
        c.jdbc("gone", table="t")


def test_attachments_are_loaded_together(spark):
    together = threading.Barrier(2, timeout=20)
    spec = lambda key, on: enrich.AttachmentSpec(key, lambda: (together.wait(), spark.createDataFrame([(1, key)], f"k_{key} int, v_{key} string"))[1], on, f"k_{key}")
    late = enrich.AttachmentSpec("c", lambda: spark.createDataFrame([("a", 7)], "k_c string, v_c int"), "v_a", "k_c")
    df = spark.createDataFrame([(1,)], "id int")
    assert enrich.Enricher([spec("a", "id"), spec("b", "id"), late]).transform(df).select("v_a", "v_b", "v_c").first() == ("a", "b", 7)
    with pytest.raises(KeyError):
        enrich.Enricher([late]).transform(df)
    assert ty.union_widened(df, df.withColumn("x", F.lit(1)), columns="common").columns == ["id"]
    with pytest.raises(ty.SchemaValidationError):
        ty.union_widened(df, df.withColumn("x", F.lit(1)), columns="same")


def test_polars_where_it_is_installed(spark):
    polars = pytest.importorskip("polars")
    got = Gateway(spark, spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")).load(id__gt=0, return_type="polars", df_options={"sort_field": "id"})
    assert isinstance(got, polars.DataFrame) and got.rows() == [(1, "a"), (2, None)]
