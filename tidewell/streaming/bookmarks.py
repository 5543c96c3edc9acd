"""Incremental loads from persisted high-water marks."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import hadoop


class Store(Protocol):
    def read(self, source: str) -> Any: ...

    def write(self, source: str, value: Any) -> None: ...


@dataclass
class MemoryStore:
    values: dict[str, Any]

    def read(self, source: str) -> Any:
        return self.values.get(source)

    def write(self, source: str, value: Any) -> None:
        self.values[source] = value


@dataclass
class JsonStore:
    """Marks of all sources in one JSON file of any file system."""

    spark: SparkSession
    path: str

    def _all(self) -> dict[str, Any]:
        return json.loads(hadoop.read_text(self.spark, self.path) or "{}")

    def read(self, source: str) -> Any:
        return self._all().get(source, {}).get("value")

    def write(self, source: str, value: Any) -> None:
        marks = self._all() | {source: {"value": value, "updated_at": dt.datetime.now(dt.UTC).isoformat()}}
        hadoop.write_text(self.spark, self.path, json.dumps(marks, default=str))


@dataclass
class TableStore:
    """Marks as rows (source, value, updated_at) of a Parquet dataset; the newest row of a source counts."""

    spark: SparkSession
    path: str

    def read(self, source: str) -> Any:
        if not hadoop.listed(self.spark, self.path, ".parquet"):
            return None
        rows = self.spark.read.schema("source string, value string, updated_at timestamp").parquet(self.path).where(F.col("source") == source)
        row = rows.agg(F.max_by("value", "updated_at")).first()
        return None if row[0] is None else json.loads(row[0])

    def write(self, source: str, value: Any) -> None:
        row = [(source, json.dumps(value, default=str), dt.datetime.now(dt.UTC))]
        self.spark.createDataFrame(row, "source string, value string, updated_at timestamp").coalesce(1).write.mode("append").parquet(self.path)


def build_filters(field: str, mark: Any, operator: str = "gt") -> dict[str, Any]:
    if operator not in ("gt", "gte"):
        raise ValueError("operator is gt or gte")
    return {} if mark is None else {f"{field}__{operator}": mark}


def high_water(df: DataFrame, field: str) -> Any:
    """The largest value, or None without one."""
    return df.agg(F.max(f"`{field}`")).first()[0]


def typed(mark: Any, kind: T.DataType) -> Any:
    """A mark that came back as text, as a value of the column's type."""
    if mark is None or not isinstance(mark, str) or isinstance(kind, T.StringType):
        return mark
    if isinstance(kind, T.IntegralType):
        return int(mark)
    if isinstance(kind, T.FractionalType):
        return float(mark)
    if isinstance(kind, T.DateType):
        return dt.date.fromisoformat(mark[:10])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return dt.datetime.fromisoformat(mark)
    return mark


@dataclass(frozen=True)
class Increment:
    frame: DataFrame
    previous: Any
    current: Any
    committed: bool

    @property
    def changed(self) -> bool:
        return self.current is not None and self.current != self.previous


def load(read: Callable[[Mapping[str, Any]], DataFrame], field: str, store: Store, source: str, *, operator: str = "gt", initial: Any = None, commit: bool = True) -> Increment:
    """Rows past the stored mark, and the mark they lead to.

    A stored 0 is a mark. A mark never moves back. It is committed when the
    maximum is known; write the rows first and ``commit_mark`` after, if a mark
    must follow a write. The frame ends at the mark, though rows may come later.
    """
    previous = store.read(source)
    previous = initial if previous is None else previous
    schema = read({}).schema
    previous = typed(previous, schema[field].dataType)
    df = read(build_filters(field, previous, operator))
    current = high_water(df, field)
    if current is not None:
        df = df.where(~F.coalesce(F.col(f"`{field}`") > F.lit(current), F.lit(False)))
    if current is None or previous is not None and current < previous:
        current = previous
    moved = current is not None and current != previous
    if commit and moved:
        store.write(source, current)
    return Increment(df, previous, current, commit and moved)


def commit_mark(store: Store, source: str, increment: Increment) -> bool:
    if increment.changed:
        store.write(source, increment.current)
    return increment.changed


# --------------------------------------------------------- file source streams
def replay(spark: SparkSession, path: str, schema: T.StructType, to: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> int:
    """Append the files that a checkpoint hasn't seen yet to a Parquet dataset; returns how many rows they had."""
    stream = spark.readStream.schema(schema).parquet(path)
    out = transform(stream) if transform else stream
    query = out.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
