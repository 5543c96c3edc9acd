"""Parquet sources: files, directories, date ranges and evolved schemas."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import types as ty
from tidewell.sources import hadoop

#: The record that sinks keep beside a dataset's files; readers of Parquet pass over names like this.
RECORD = "_schema.json"


@dataclass(frozen=True)
class Record:
    """What a dataset's files have: all columns with the types that they widen to, those that folders name, whether all
    files have just these data columns, and the time of the newest file that was looked at."""

    schema: T.StructType
    partition_on: tuple[str, ...] = ()
    uniform: bool = True
    at: int = 0

    def data(self) -> T.StructType:
        return T.StructType([f for f in self.schema if f.name not in self.partition_on])

    def folders(self) -> T.StructType:
        return T.StructType([f for f in self.schema if f.name in self.partition_on])


def record(spark: SparkSession, path: str) -> Record | None:
    # below a file some file systems take such a question for an error
    text = hadoop.read_text(spark, f"{path.rstrip('/')}/{RECORD}") if hadoop.is_folder(spark, path) else None
    if text is None:
        return None
    found = json.loads(text)
    return Record(T.StructType.fromJson(found["schema"]), tuple(found["partition_on"]), found["uniform"], found["at"])


def write_record(spark: SparkSession, path: str, rec: Record) -> None:
    hadoop.write_text(spark, f"{path.rstrip('/')}/{RECORD}", json.dumps({"schema": rec.schema.jsonValue(), "partition_on": list(rec.partition_on), "uniform": rec.uniform, "at": rec.at}))


def current(spark: SparkSession, path: str, folders: T.StructType | None = None) -> Record | None:
    """A dataset's record with what files say that came after it; only their footers are read. None without files.

    ``folders`` has the types of columns that folders name, where no record has them.
    """
    old = record(spark, path)
    names, newest = hadoop.newer(spark, path, ".parquet", old.at if old else -1)
    if not names:
        return old if newest else None
    schemas = [s for s, _ in _schemas(spark, names).values()]
    folders = old.folders() if old else folders or T.StructType([])
    types = {f.name: f.dataType for f in old.data()} if old else {}
    uniform = old is None or old.uniform
    for schema in schemas:
        own = {f.name: f.dataType for f in schema}
        uniform = uniform and (not types or own == types)
        for name, kind in own.items():
            types[name] = (ty.widened(types[name], kind) or T.StringType()) if name in types else kind
    fields = [T.StructField(c, t) for c, t in types.items()]
    return Record(T.StructType([*fields, *folders]), tuple(f.name for f in folders), uniform, newest)


def read_dataset(spark: SparkSession, path: str, folders: T.StructType | None = None) -> DataFrame:
    """A dataset with the types of its record, those of columns that folders name included.

    Without a record types come from the files, and those of folders from
    ``folders`` or else from their names.
    """
    rec = record(spark, path)
    if rec is None:
        if not folders:
            return spark.read.parquet(path)
        rec = current(spark, path, folders)
        if rec is None:
            return spark.createDataFrame([], T.StructType([]))
    if rec.uniform:
        return spark.read.schema(rec.schema).parquet(path)
    return read_evolved(spark, path, rec.folders())


class StaleFileError(RuntimeError):
    """A file is older than its source allows."""


@dataclass(frozen=True)
class ParquetSource:
    """A dataset at a path.

    ``start`` and ``end`` bound the first column of ``partition_on``, or the
    dates of a year/month/day layout; both ends belong to the range.
    """

    path: str
    filename: str | None = None
    start: Any = None
    end: Any = None
    partition_on: Sequence[str] = ()
    max_age_minutes: float | None = None
    schema: T.StructType | None = None
    evolved: bool = False

    def __post_init__(self):
        if any("\0" in str(x) for x in (self.path, self.filename or "")) or ".." in str(self.filename or "").replace("\\", "/").split("/"):
            raise ValueError("the file lies outside its folder")
        if self.start is not None and self.end is not None and str(self.start) > str(self.end):
            raise ValueError("the range ends before it starts")

    def read(self, spark: SparkSession) -> DataFrame:
        path = self.path
        if self.filename:
            name = self.filename if self.filename.endswith(".parquet") else f"{self.filename}.parquet"
            path = f"{path.rstrip('/')}/{name}"
        if self.max_age_minutes is not None:
            check_age(spark, path, self.max_age_minutes)
        try:
            if self.evolved:
                df = read_evolved(spark, path)
            else:
                days = not self.partition_on and (self.start is not None or self.end is not None)
                if self.schema is None and not days and record(spark, path) is not None:
                    df = read_dataset(spark, path)
                else:
                    reader = spark.read.schema(self.schema) if self.schema else spark.read
                    # folders of days are no columns
                    df = (reader.option("recursiveFileLookup", "true") if days else reader).parquet(path)
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return spark.createDataFrame([], self.schema or T.StructType([]))
        return self._ranged(spark, df, path)

    def _ranged(self, spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
        if self.start is None and self.end is None:
            return df
        if self.partition_on:
            c = F.col(f"`{self.partition_on[0]}`")
            kind = df.schema[self.partition_on[0]].dataType
            lit = (lambda v: F.lit(str(v))) if isinstance(kind, T.StringType) else (lambda v: F.lit(str(v)).cast(kind))
        else:
            found = spark.read.option("recursiveFileLookup", "true").schema(df.schema).parquet(path)
            parts = F.regexp_extract_all(F.col("_metadata.file_path"), F.lit(r"/(?:year=)?(\d{4})/(?:month=)?(\d{1,2})/(?:day=)?(\d{1,2})/"), F.lit(0))
            last = F.element_at(parts, -1)
            digits = [F.regexp_extract(last, rf"(?:{k}=)?{r}", 1).cast("int") for k, r in (("year", r"(\d{4})/"), ("month", r"\d{4}/(?:month=)?(\d{1,2})/"), ("day", r"\d{4}/(?:month=)?\d{1,2}/(?:day=)?(\d{1,2})/"))]
            df = found.withColumn("_day", F.make_date(*digits))
            c, lit = F.col("_day"), lambda v: F.lit(str(v)[:10]).cast("date")
        if self.start is not None:
            df = df.where(c >= lit(self.start))
        if self.end is not None:
            df = df.where(c <= lit(self.end))
        return df.drop("_day")


def check_age(spark: SparkSession, path: str, minutes: float) -> None:
    newest = _status(spark, path)[1]
    age = (dt.datetime.now(dt.UTC).timestamp() - newest / 1000) / 60
    if age > minutes:
        raise StaleFileError(f"{path} is {age:.0f} minutes old; {minutes:g} are allowed")


def _status(spark: SparkSession, path: str) -> tuple[int, int]:
    """Bytes below a path and its newest modification in milliseconds."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(sc._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength(), fs.getFileStatus(p).getModificationTime()


def _schemas(spark: SparkSession, names: list[str]) -> dict[str, tuple[T.StructType, list[str]]]:
    """The schemas that occur, by text, each with its files. One job reads the footers, a file a row."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    def footers(batches):
        for rows in batches:
            out = []
            for name in rows["path"]:
                try:
                    fs, path = pafs.FileSystem.from_uri(name)
                    with fs.open_input_file(path) as file:
                        found = pq.read_schema(file)
                    own = (found.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
                    out.append(own.decode() if own else None)
                except Exception:  # whatever a path is of that only Spark can open
                    out.append(None)
            yield rows.assign(schema=out)

    told = spark.createDataFrame([(n,) for n in names], "path string").repartition(min(len(names), 200)).mapInPandas(footers, "path string, schema string").collect()
    groups: dict[str, tuple[T.StructType, list[str]]] = {}
    for row in sorted(told):
        # files that Spark didn't write, or that tasks can't open, are asked one by one
        schema = T.StructType.fromJson(json.loads(row.schema)) if row.schema else spark.read.parquet(row.path).schema
        groups.setdefault(",".join(f"{f.name} {f.dataType.simpleString()}" for f in schema), (schema, []))[1].append(row.path)
    return groups


def read_evolved(spark: SparkSession, path: str, folders: T.StructType | None = None) -> DataFrame:
    """Files whose schemas differ: each column has the type that all widen to, or text.

    Files of one schema are one scan. Columns that folders name (``p=1``) come
    too, with the types of ``folders`` or of the dataset's record if there are
    any, and filters on them leave folders unread.
    """
    if folders is None and (rec := record(spark, path)) is not None:
        folders = rec.folders()
    files = spark.read.option("recursiveFileLookup", "true").format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    names = sorted(r.path for r in files.toLocalIterator())
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    scans = []
    for schema, own in _schemas(spark, names).values():
        reader = spark.read.option("basePath", path) if any("=" in n[len(path) :] for n in own) else spark.read
        scans.append(reader.schema(T.StructType([*schema, *(folders or [])])).parquet(*own))
    return ty.union_widened(*scans)


def summary(df: DataFrame) -> dict[str, int]:
    """Files and bytes a scan would read, by the planner's own estimate."""
    return {"files": len(df.inputFiles()), "bytes": int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))}


@dataclass(frozen=True)
class Footers:
    """Rows, and the least and largest value of columns, that are no nulls."""

    rows: int
    bounds: dict[str, tuple[Any, Any]]
    pushed: bool


def footer_bounds(spark: SparkSession, path: str, columns: Sequence[str] = (), where: Any = None) -> Footers:
    """Row count and bounds of a dataset from its files' footers, without their rows.

    Spark's Parquet reader takes such aggregates whole where columns are
    numbers, booleans or dates (or name folders) and no filter is left over
    (one on columns that name folders isn't); else, the same plan reads the
    columns, and so it does where a file has nothing but nulls in one. ``pushed``
    tells which it was.
    """
    own = spark.newSession()  # the reader that takes aggregates is chosen by settings, and others keep theirs
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    rec = record(spark, path)
    reader = own.read.schema(rec.schema) if rec is not None and rec.uniform else own.read
    made = [x for c in columns for x in (F.min(f"`{c}`"), F.max(f"`{c}`"))]

    def asked(push: bool) -> DataFrame:
        own.conf.set("spark.sql.parquet.aggregatePushdown", str(push).lower())
        df = reader.parquet(path)
        return (df if where is None else df.where(where)).agg(F.count(F.lit(1)), *made)

    plan = asked(True)
    pushed = "PushedAggregation: [COUNT" in plan._jdf.queryExecution().executedPlan().toString()
    try:
        n, *found = plan.first()
    except Exception:
        if not pushed:
            raise
        # a file all of whose values of a column are null has no bounds of it, which the reader takes for an error
        pushed = False
        n, *found = asked(False).first()
    return Footers(n, {c: (found[2 * k], found[2 * k + 1]) for k, c in enumerate(columns)}, pushed)
