"""Sinks: Parquet, CSV, JSON lines and upsert, with staged overwrites and widening appends."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import filters as fl
from tidewell.functions import types as ty
from tidewell.plans import telemetry
from tidewell.sources import files, hadoop
from tidewell.streaming import bookmarks


class SchemaNarrowingError(ValueError):
    """An append's columns don't fit what the dataset has."""


class PartitionValueError(ValueError):
    """A partition value can't be a folder's name."""


@dataclass(frozen=True)
class SinkResult:
    path: str
    files: tuple[str, ...]


class Sink(Protocol):
    def write(self, df: DataFrame, *, overwrite: bool = True) -> SinkResult: ...


def with_partition_date(df: DataFrame, source: str, name: str = "partition_date") -> DataFrame:
    """The date of a column as text; null where it has none."""
    c = F.col(f"`{source}`")
    day = F.to_date(c) if not isinstance(df.schema[source].dataType, T.StringType) else F.coalesce(c.try_cast("timestamp").try_cast("date"), c.try_cast("date"))
    return df.withColumn(name, day.cast("string"))


#: What a failed write says of a partition value, for the driver to tell it from other failures.
_BAD = "can't be a folder's name"


def _bad(c: str) -> Column:
    c = F.col(f"`{c}`")
    return c.isin("", ".", "..") | c.contains("/") | c.contains("\\") | c.contains("\0")


def check_partitions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` whose write fails where a value of a partition column is empty, a relative folder, or holds a separator or NUL."""
    for c in columns:
        if c not in df.columns:
            raise KeyError(f"{c}: no such column to partition by")
    texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: F.when(_bad(c), F.raise_error(F.concat(F.lit(f"{c} = "), F.col(f"`{c}`"), F.lit(f" {_BAD}"))).cast("string")).otherwise(F.col(f"`{c}`")) for c in texts})


def _safe(path: str) -> str:
    if not path or "\0" in path:
        raise ValueError("a sink needs a path without NUL")
    return path.rstrip("/")


def check_widening(new: T.StructType, old: T.StructType) -> T.StructType:
    """The dataset's schema with the append's columns; an append may lack columns, add some, and have narrower or wider ones."""
    merged = {f.name: f.dataType for f in old}
    for f in new:
        if f.name not in merged:
            merged[f.name] = f.dataType
        elif (t := ty.widened(merged[f.name], f.dataType)) is None:
            raise SchemaNarrowingError(f"{f.name}: {f.dataType.simpleString()} doesn't go with {merged[f.name].simpleString()}")
        else:
            merged[f.name] = t
    return T.StructType([T.StructField(n, t) for n, t in merged.items()])


@dataclass(frozen=True)
class _Folder:
    spark: SparkSession
    path: str
    partition_on: Sequence[str] = ()
    options: dict[str, str] = field(default_factory=dict)
    kind = "parquet"
    suffix = ".parquet"

    def write(self, df: DataFrame, *, overwrite: bool = True) -> SinkResult:
        """Overwriting writes a sibling folder and then swaps, so that a dataset may be read while it is replaced."""
        path = _safe(self.path)
        df = check_partitions(df, self.partition_on)
        with telemetry.span("sink", kind=self.kind):
            before = set() if overwrite else set(hadoop.listed(self.spark, path, self.suffix))
            if overwrite:
                staged = f"{path}.staging-{uuid.uuid4().hex}"
                self._save(df, staged, "errorifexists")
                self._noted(df, staged, None)
                hadoop.swap(self.spark, staged, path)
            else:
                old = self._check_append(df, path)
                self._save(df, path, "append")
                self._noted(df, path, old)
        return SinkResult(path, tuple(f for f in hadoop.listed(self.spark, path, self.suffix) if f not in before))

    def _check_append(self, df: DataFrame, path: str) -> files.Record | None:
        return None

    def _noted(self, df: DataFrame, path: str, old: files.Record | None) -> None:
        pass

    def _save(self, df: DataFrame, path: str, mode: str) -> None:
        writer = df.write.mode(mode).options(**self.options)
        if self.partition_on:
            writer = writer.partitionBy(*self.partition_on)
        _written(getattr(writer, self.kind), path)


def _written(write: Callable[[str], None], path: str) -> None:
    """Write; a bad partition value, found by the tasks, is the caller's error."""
    try:
        write(path)
    except Exception as e:
        if _BAD in str(e):
            raise PartitionValueError(next(x for x in str(e).split("\n") if _BAD in x)) from e
        raise


@dataclass(frozen=True)
class ParquetSink(_Folder):
    date_field: str | None = None

    def write(self, df: DataFrame, *, overwrite: bool = True) -> SinkResult:
        if self.date_field and "partition_date" in self.partition_on and "partition_date" not in df.columns:
            df = with_partition_date(df, self.date_field)
        return super().write(df, overwrite=overwrite)

    def _check_append(self, df: DataFrame, path: str) -> files.Record | None:
        """What the dataset has, if the append goes with it; only footers of files that the record doesn't know are read."""
        old = files.current(self.spark, path, self._folders(df))
        if old is not None:
            check_widening(T.StructType([f for f in df.schema if f.name not in self.partition_on]), old.data())
        return old

    def _folders(self, df: DataFrame) -> T.StructType:
        return T.StructType([T.StructField(c, df.schema[c].dataType) for c in self.partition_on])

    def _noted(self, df: DataFrame, path: str, old: files.Record | None) -> None:
        """Keep the types beside the files: readers need no guesses from folders' names, and appends no old footers."""
        own = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name not in self.partition_on])
        merged, uniform = own, True
        if old is not None:
            merged = check_widening(own, old.data())
            types = lambda s: {f.name: f.dataType for f in s}
            uniform = old.uniform and types(own) == types(old.data())
        folders = old.folders() if old is not None and old.partition_on else self._folders(df)
        newest = hadoop.newer(self.spark, path, self.suffix, -1)[1]
        files.write_record(self.spark, path, files.Record(T.StructType([*merged, *folders]), tuple(f.name for f in folders), uniform, newest))


@dataclass(frozen=True)
class CsvSink(_Folder):
    kind = "csv"
    suffix = ".csv"

    def __post_init__(self):
        if len(self.partition_on) > 1:
            raise ValueError("a CSV dataset has one partition column at most")

    def _save(self, df: DataFrame, path: str, mode: str) -> None:
        writer = df.write.mode(mode).option("header", True).options(**self.options)
        _written((writer.partitionBy(*self.partition_on) if self.partition_on else writer).csv, path)


@dataclass(frozen=True)
class JsonlSink(_Folder):
    kind = "json"
    suffix = ".json"

    __post_init__ = CsvSink.__post_init__


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


@dataclass(frozen=True)
class UpsertSink:
    """Rows replace those of their keys: what has no new row stays.

    Of a partitioned dataset only partitions that have such a key, or get a new
    row, are read whole and replaced; where the partition columns are among the
    keys, those of the new rows are all, and no old key is looked at to find
    them. Folders are replaced one at a time, so that a driver lost meanwhile
    leaves some of them new and some old; the same upsert again completes it. A
    dataset without partitions, or one whose columns widen, is swapped as a whole.
    """

    spark: SparkSession
    path: str
    keys: Sequence[str]
    partition_on: Sequence[str] = ()

    def write(self, df: DataFrame, *, overwrite: bool = False) -> SinkResult:
        if not self.keys or any(k not in df.columns for k in self.keys):
            raise KeyError("an upsert needs its key columns")
        path = _safe(self.path)
        fresh = f"{path}.rows-{uuid.uuid4().hex}"
        try:
            # the new rows are computed once, though they are checked, matched and written
            _written(check_partitions(df, self.partition_on).write.parquet, f"{fresh}/rows")
            df = self.spark.read.schema(df.schema).parquet(f"{fresh}/rows")
            if not df.groupBy(*self.keys).count().where("count > 1").isEmpty():
                raise ValueError("several rows of one key")
            if overwrite or not hadoop.listed(self.spark, path, ".parquet"):
                return ParquetSink(self.spark, path, self.partition_on).write(self._gathered(df))
            folders = T.StructType([T.StructField(c, df.schema[c].dataType) for c in self.partition_on])
            old, uniform = files.read_dataset(self.spark, path, folders), files.current(self.spark, path, folders).uniform
            same = check_widening(df.schema, old.schema) == T.StructType([T.StructField(f.name, f.dataType) for f in old.schema])
            if self.partition_on and uniform and same and set(df.columns) == set(old.columns):
                return self._replace(df, old, path, fresh)
            merged = ty.union_widened(self._without(old, df), df, stringify=False)
            return ParquetSink(self.spark, path, self.partition_on).write(self._gathered(merged))
        finally:
            hadoop.delete(self.spark, fresh)

    def _without(self, old: DataFrame, df: DataFrame) -> DataFrame:
        return old.join(df, _all([old[k].eqNullSafe(df[k]) for k in self.keys]), "left_anti")

    def _replace(self, df: DataFrame, old: DataFrame, path: str, fresh: str) -> SinkResult:
        parts = list(self.partition_on)
        touched = df.select(*parts)
        if not set(parts) <= set(self.keys):
            touched = touched.unionByName(old.join(df, _all([old[k].eqNullSafe(df[k]) for k in self.keys]), "left_semi").select(*parts))
        touched.distinct().write.parquet(f"{fresh}/parts")
        touched = self.spark.read.schema(touched.schema).parquet(f"{fresh}/parts")
        places = old.select(*parts, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("_folder"))
        places = places.join(touched, _all([places[c].eqNullSafe(touched[c]) for c in parts]), "left_semi").select("_folder").distinct()
        before = set(hadoop.below(self.spark, path, [r[0] for r in places.collect()], uri=True))  # as many as partitions are touched
        # only their folders are read
        own = [hadoop.joined(self.spark, path, x) for x in sorted(before)]
        some = self.spark.read.schema(old.schema).option("basePath", path).parquet(*own) if own else old.limit(0)
        staged = f"{fresh}/staged"
        ParquetSink(self.spark, staged, parts)._save(self._gathered(self._without(some, df).unionByName(df)), staged, "errorifexists")
        now = {f.rsplit("/", 1)[0] for f in hadoop.below(self.spark, staged, hadoop.listed(self.spark, staged, ".parquet"))}
        for folder in sorted(now):
            hadoop.swap(self.spark, f"{staged}/{folder}", f"{path}/{folder}")
        for folder in sorted(before - now):  # all its rows went to other partitions
            hadoop.delete(self.spark, f"{path}/{folder}")
        files_ = hadoop.listed(self.spark, path, ".parquet")
        return SinkResult(path, tuple(f for f, own in zip(files_, hadoop.below(self.spark, path, files_), strict=True) if own.rsplit("/", 1)[0] in now))

    def _gathered(self, df: DataFrame) -> DataFrame:
        """Rows of a partition together, but for large ones, which are split again: few files, and no task with most rows."""
        return df.hint("rebalance", *self.partition_on) if self.partition_on else df


# ------------------------------------------------------------------ registry
_SINKS: dict[str, Callable[..., Sink]] = {"parquet": ParquetSink, "csv": CsvSink, "jsonl": JsonlSink, "upsert": UpsertSink}


def register_sink(name: str, factory: Callable[..., Sink], *, replace: bool = False) -> None:
    if name in _SINKS and not replace:
        raise ValueError(f"{name} is registered already")
    _SINKS[name] = factory


def create_sink(name: str, *args: Any, **options: Any) -> Sink:
    if name not in _SINKS:
        raise KeyError(f"{name!r}: sinks are {', '.join(available_sinks())}")
    return _SINKS[name](*args, **options)


def available_sinks() -> list[str]:
    return sorted(_SINKS)


def write_parquet(df: DataFrame, path: str, partition_on: Sequence[str] = (), *, overwrite: bool = True) -> SinkResult:
    return ParquetSink(df.sparkSession, path, partition_on).write(df, overwrite=overwrite)


# ----------------------------------------------------------------- pipelines
@dataclass
class SinkPipeline:
    """Load, enrich, write: one plan, and one read of the source."""

    source: Any
    sink: Sink
    enrich: Any = None

    def write(self, *, overwrite: bool = True, **request: Any) -> SinkResult:
        df = self.source.load(**request)
        return self.sink.write(self.enrich.transform(df) if self.enrich else df, overwrite=overwrite)


@dataclass(frozen=True)
class Materialization:
    path: str
    files: tuple[str, ...]
    frame: DataFrame | None
    mark: Any = None


@dataclass
class ParquetPipeline(SinkPipeline):
    """Write a Parquet dataset and read it back, whole or from a mark on."""

    def materialize(self, *, reload: bool = True, overwrite: bool = True, **request: Any) -> Materialization:
        result = self.write(overwrite=overwrite, **request)
        return Materialization(result.path, result.files, files.read_dataset(self.sink.spark, result.path) if reload else None)

    def incremental(self, field_: str, store: bookmarks.Store, source: str, *, operator: str = "gt", initial: Any = None, overwrite: bool = False, **request: Any) -> Materialization:
        """The rows past the mark are written, their maximum is observed on the way, and then the mark moves."""
        if request.get("limit") is not None:
            raise ValueError("an increment has no limit, as the mark would pass rows that it leaves out")
        columns = request.get("columns")
        extra = columns is not None and field_ not in columns
        df = self.source.load(**request | ({"columns": [*columns, field_]} if extra else {}))
        previous = store.read(source)
        previous = bookmarks.typed(initial if previous is None else previous, df.schema[field_].dataType)
        # both hold: the caller's filters and the mark
        df = fl.apply(df, bookmarks.build_filters(field_, previous, operator))
        df = self.enrich.transform(df) if self.enrich else df
        seen = Observation()
        df = df.observe(seen, F.max(field_).alias("mark"), F.count(F.lit(1)).alias("rows"))
        result = self.sink.write(df.drop(field_) if extra else df, overwrite=overwrite)
        mark = seen.get.get("mark")
        if mark is not None and (previous is None or mark > previous):
            store.write(source, mark)
        return Materialization(result.path, result.files, files.read_dataset(self.sink.spark, result.path), mark)
