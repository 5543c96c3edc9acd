"""The facade: one request becomes one lazy plan."""

from __future__ import annotations

import asyncio
import logging
import threading
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as FutureTimeout
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tidewell.functions import fieldmap as fm
from tidewell.functions import filters as fl
from tidewell.functions import types as ty
from tidewell.operators import joins, shape
from tidewell.plans import telemetry
from tidewell.sources import files, guard, jdbc
from tidewell.streaming import bookmarks

log = logging.getLogger(__name__)
RETURN_TYPES = ("spark", "pandas", "arrow", "polars", "auto")
#: A result of up to so many rows is "small" for ``return_type="auto"``.
AUTO_ROWS = 10_000
#: ... and so is one of up to so many files and estimated bytes.
AUTO_FILES, AUTO_BYTES = 4, 32 << 20
#: Names that are options of a load; all others are filters.
CONTROLS = frozenset("filters columns limit sql params allow_raw_sql return_type df_options exclude since watermark_store watermark_source watermark_operator watermark_initial persist dry_run diagnostics timeout start end dt_field statement return_schema".split())


@dataclass(frozen=True)
class FrameOptions:
    """Shaping after the load, in this order: names, selection, positional names, sort, duplicates, grouping, index."""

    fieldnames: Sequence[str] | None = None
    column_names: Sequence[str] | None = None
    sort_field: str | Sequence[Any] | None = None
    duplicate_expr: str | Sequence[str] | None = None
    duplicate_keep: str | bool = "last"
    group_by_expr: str | Sequence[str] | None = None
    group_expr: Any = None
    index_col: str | None = None
    datetime_index: str | None = None

    def shape(self, df: DataFrame) -> DataFrame:
        df = shape.select_fields(df, self.fieldnames)
        if self.column_names:
            df = fm.positional(df, self.column_names)
        if self.duplicate_expr:
            df = shape.deduplicate(df, self.duplicate_expr, self.duplicate_keep, _names(self.sort_field))
        if self.group_by_expr:
            df = shape.group(df, self.group_by_expr, self.group_expr or "count", _names(self.sort_field))
            keys = {self.group_by_expr} if isinstance(self.group_by_expr, str) else set(self.group_by_expr)
            if self.sort_field and set(_names(self.sort_field)) <= set(df.columns) | keys:
                df = shape.sort(df, self.sort_field)
        elif self.sort_field:
            # groups and single rows of keys have no order, so the sort comes after them
            df = shape.sort(df, self.sort_field)
        return df


def _names(sort: Any) -> list[str] | None:
    if sort is None:
        return None
    return [sort] if isinstance(sort, str) else [k if isinstance(k, str) else k[0] for k in sort]


@dataclass
class Gateway:
    """A source with a field map, filters that always hold and shaping that is always done.

    ``source`` has ``read(spark)``, or is a DataFrame, or a table's name.
    """

    spark: SparkSession
    source: Any
    field_map: Mapping[str, str] = field(default_factory=dict)
    filters: Mapping[str, Any] = field(default_factory=dict)
    options: FrameOptions = field(default_factory=FrameOptions)
    allowed: Sequence[str] | None = None
    exclude: bool = False

    # ------------------------------------------------------------ planning
    def relation(self) -> DataFrame:
        if isinstance(self.source, DataFrame):
            return self.source
        if isinstance(self.source, str):
            return self.spark.table(self.source)
        return self.source.read(self.spark)

    def load(self, filters: Mapping[str, Any] | None = None, **more: Any) -> Any:
        """One lazy plan; ``return_type`` other than spark collects it.

        Runtime filters win over the gateway's own on the same key; ``filters``
        wins over keywords. With ``since``, a field or (field, store, source),
        only rows past the source's mark come, and the mark moves when they are
        there; ``watermark_store`` and ``watermark_source`` (the table, if not
        given) go with a field.
        """
        controls = {k: more.pop(k) for k in list(more) if k in CONTROLS}
        kind = controls.get("return_type", "spark")
        if kind not in RETURN_TYPES:
            raise ValueError(f"return_type is one of {', '.join(RETURN_TYPES)}")
        if controls.get("since") is None:
            df = self._finished(self._filtered(filters, more, controls), controls)
            return df if controls.get("dry_run") else self._returned(df, kind, self._options(controls), controls.get("timeout"))
        field_, store, source = self._since(controls)
        found = self._past(field_, store, source, controls.get("watermark_operator", "gt"), controls.get("watermark_initial"), filters, more, controls)
        if controls.get("dry_run"):
            return found.frame
        out = self._returned(found.frame, kind, self._options(controls), controls.get("timeout"))
        bookmarks.commit_mark(store, source, found)
        return out

    def _filtered(self, filters: Mapping[str, Any] | None, more: Mapping[str, Any], controls: Mapping[str, Any]) -> DataFrame:
        """All columns, by semantic names, of the rows for which filters and period hold."""
        if controls.get("sql"):
            df = guard.run(self.spark, controls["sql"], controls.get("params"), allow_raw_sql=controls.get("allow_raw_sql", False))
        else:
            df = controls.get("statement")
            df = self.relation() if df is None else df
        names = fm.FieldMap(self.field_map)
        given = dict(self.filters) | dict(more) | dict(filters or controls.get("filters") or {})
        semantic = [self.field_map.get(c, c) for c in df.columns]
        expr = names.filters(fl.parse(given, semantic))
        if self.allowed is not None and (bad := {self.field_map.get(c, c) for c in fl.fields(expr)} - set(self.allowed)):
            raise fl.FilterError(f"not to be filtered by: {', '.join(sorted(bad))}")
        df = fl.apply(df, expr, exclude=controls.get("exclude", self.exclude))
        if controls.get("start") is not None or controls.get("end") is not None:
            df = fl.apply(df, names.filters(fl.parse(fl.period(controls["dt_field"], controls["start"], controls["end"]), semantic)))
        return names.apply(df)

    def _options(self, controls: Mapping[str, Any]) -> FrameOptions:
        options = controls.get("df_options") or self.options
        return FrameOptions(**options) if isinstance(options, Mapping) else options

    def _finished(self, df: DataFrame, controls: Mapping[str, Any]) -> Any:
        """The frame as it was asked for, or the plan's text."""
        df = shape.select_fields(df, controls.get("columns"))
        df = self._options(controls).shape(df)
        if controls.get("return_schema"):
            df = ty.apply_schema_map(df, controls["return_schema"])
        if controls.get("limit") is not None:
            df = df.limit(controls["limit"])
        if controls.get("diagnostics"):
            log.info("plan:\n%s", df._jdf.queryExecution().toString())
        if controls.get("dry_run"):
            return df._jdf.queryExecution().toString()
        return df.persist(StorageLevel.MEMORY_AND_DISK) if controls.get("persist") else df

    def _since(self, controls: Mapping[str, Any]) -> tuple[str, bookmarks.Store, str]:
        since, store, source = controls["since"], controls.get("watermark_store"), controls.get("watermark_source")
        if isinstance(since, tuple):
            if len(since) != 3:
                raise ValueError("since is a field or (field, store, source)")
            since, store, source = since
        elif not isinstance(since, str):
            raise TypeError("since is a field or (field, store, source)")
        if store is None:
            raise ValueError("since needs a store of marks: give watermark_store")
        source = source or (self.source if isinstance(self.source, str) else getattr(self.source, "table", None) or getattr(self.source, "path", None))
        if not source:
            raise ValueError("since needs a name for the mark: give watermark_source")
        return since, store, source

    def _past(self, field_: str, store: bookmarks.Store, source: str, operator: str, initial: Any, filters: Mapping[str, Any] | None, more: Mapping[str, Any], controls: Mapping[str, Any]) -> bookmarks.Increment:
        """The rows past a mark; the mark is a condition of its own, whatever the request excludes or filters by, and is taken before columns are."""
        if controls.get("limit") is not None:
            raise ValueError("a load past a mark has no limit, as the mark would pass rows that it leaves out")
        df = self._filtered(filters, more, controls)
        found = bookmarks.load(lambda mark: fl.apply(df, mark), field_, store, source, operator=operator, initial=initial, commit=False)
        return replace(found, frame=self._finished(found.frame, controls))

    def _returned(self, df: DataFrame, kind: str, options: FrameOptions, timeout: float | None) -> Any:
        if kind == "auto":
            # few and small files, or few rows, are small; what the planner thinks huge isn't counted
            size = files.summary(df)
            small = 0 < size["files"] <= AUTO_FILES and size["bytes"] <= AUTO_BYTES
            kind = "pandas" if small or shape.bounded_count(df, AUTO_ROWS) <= AUTO_ROWS else "spark"
        if kind == "spark":
            return df
        with telemetry.span("collect", kind=kind):
            table = _within(self.spark, df.toArrow, timeout)
        if kind == "arrow":
            if options.index_col or options.datetime_index:
                raise ValueError("an Arrow table has no index")
            return table
        if kind == "polars":
            import polars

            return polars.from_arrow(table)
        out = table.to_pandas()
        if options.datetime_index:
            import pandas as pd

            out[options.datetime_index] = pd.to_datetime(out[options.datetime_index], errors="coerce")
            return out.set_index(options.datetime_index)
        return out.set_index(options.index_col) if options.index_col else out

    # ----------------------------------------------------------- variations
    async def aload(self, filters: Mapping[str, Any] | None = None, **more: Any) -> Any:
        return await asyncio.to_thread(self.load, filters, **more)

    async def adescribe(self, most: int = 10_000, **more: Any) -> dict[str, Any]:
        return await asyncio.to_thread(self.describe, most, **more)

    async def apreview(self, n: int = 5, **more: Any):
        return await asyncio.to_thread(self.preview, n, **more)

    async def aload_incremental(self, field_: str, store: bookmarks.Store, source: str, **more: Any) -> bookmarks.Increment:
        return await asyncio.to_thread(self.load_incremental, field_, store, source, **more)

    def load_period(self, dt_field: str, start: Any, end: Any, **more: Any) -> Any:
        return self.load(dt_field=dt_field, start=start, end=end, **more)

    def load_incremental(self, field_: str, store: bookmarks.Store, source: str, *, operator: str = "gt", initial: Any = None, commit: bool = True, filters: Mapping[str, Any] | None = None, **more: Any) -> bookmarks.Increment:
        """The rows past a mark, with ``load``'s filters and options; both the mark and filters on its field hold.

        The source is read for the maximum, and again when the frame is; where
        rows go to a sink, ``ParquetPipeline.incremental`` reads it once.
        """
        controls = {k: more.pop(k) for k in list(more) if k in CONTROLS}
        found = self._past(field_, store, source, operator, initial, filters, more, controls)
        return replace(found, committed=commit and bookmarks.commit_mark(store, source, found))

    def semi_join(self, keys: DataFrame | Sequence, on: str, **more: Any) -> DataFrame:
        return joins.semi_join(self.load(**more), keys, on)

    def preview(self, n: int = 5, **more: Any):
        return self.load(**more).limit(n).toPandas()

    def describe(self, most: int = 10_000, **more: Any) -> dict[str, Any]:
        return jdbc.described(self.load(**more), most)

    def scan_summary(self) -> dict[str, int]:
        return files.summary(self.relation())

    def iter_batches(self, size: int = 100_000, filters: Mapping[str, Any] | None = None, **more: Any) -> Iterator[pa.RecordBatch]:
        """All rows as Arrow batches of up to ``size``, a partition at a time on the driver."""
        df = self.load(filters, **more)

        def pack(batches):
            # a row a batch, so that rows stay columns on their way
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part, out = batch.slice(at, size), pa.BufferOutputStream()
                    with pa.ipc.new_stream(out, part.schema) as writer:
                        writer.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["ipc"])

        held: list[pa.RecordBatch] = []
        for row in df.mapInArrow(pack, "ipc binary").toLocalIterator(prefetchPartitions=True):
            held += pa.ipc.open_stream(row.ipc)
            while sum(b.num_rows for b in held) >= size:
                table = pa.Table.from_batches(held)
                yield table.slice(0, size).combine_chunks().to_batches()[0]
                held = table.slice(size).to_batches()
        if sum(b.num_rows for b in held):
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def iter_pages(self, key: str, size: int = jdbc.CHUNK, filters: Mapping[str, Any] | None = None, **more: Any) -> Iterator[DataFrame]:
        """Pages of up to ``size`` rows in the order of a unique key, each by the rows past the last one's key."""
        return jdbc.keyset(self.load(filters, **more), key, size)

    def load_paged(self, key: str, size: int = jdbc.CHUNK, filters: Mapping[str, Any] | None = None, **more: Any) -> DataFrame:
        """All rows with their ``page``, as ``iter_pages`` cuts them, in one read."""
        return jdbc.paged(self.load(filters, **more), key, size)

    def with_options(self, **options: Any) -> Gateway:
        return replace(self, options=replace(self.options, **options))


def _within(spark: SparkSession, action, seconds: float | None):
    """The action's result, or its jobs are cancelled after so many seconds."""
    if seconds is None:
        return action()
    group = f"tidewell-{threading.get_ident()}-{id(action)}"

    def run():
        spark.sparkContext.setJobGroup(group, "bounded load", interruptOnCancel=True)
        return action()

    with ThreadPoolExecutor(1) as pool:
        future = pool.submit(run)
        try:
            return future.result(seconds)
        except FutureTimeout:
            spark.sparkContext.cancelJobGroup(group)
            raise TimeoutError(f"the load took more than {seconds:g} s") from None


class _View:
    def __init__(self, gateway: Gateway, kind: str):
        self.gateway, self.kind = gateway, kind

    def load(self, *a: Any, **b: Any) -> Any:
        return self.gateway.load(*a, **({"return_type": self.kind} | b))


class Helper:
    """A gateway with a view for each kind of result."""

    def __init__(self, spark: SparkSession, source: Any, **more: Any):
        self.gateway = Gateway(spark, source, **more)
        self.spark, self.pandas, self.arrow, self.polars = (_View(self.gateway, k) for k in RETURN_TYPES[:4])

    def load(self, *a: Any, **b: Any) -> Any:
        return self.gateway.load(*a, **b)

    def left_join(self, right: DataFrame, left_on, right_on=None, **more: Any) -> DataFrame:
        options = {k: more.pop(k) for k in ("schema", "persist", "dry_run", "diagnostics") if k in more}
        return joins.left_join(self.gateway.load(**more), right, left_on, right_on, **options)

    def __getattr__(self, name: str) -> Any:
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.gateway, name)
