"""Joins in time: the last row before a moment, and moments within intervals. Long keys are cut into spans of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _span(c: Column, kind: T.DataType, width: float) -> Column:
    """The number of the span of ``width`` (seconds, or units of a number) that a moment lies in."""
    if isinstance(kind, T.DateType):
        c = F.unix_date(c) * 86_400
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # of a local time the clock counts, whatever the session's zone
        c = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else c) / 1e6
    elif not isinstance(kind, T.NumericType):
        raise TypeError("a moment is a date, a time or a number")
    return F.floor(c / width).cast("long")


def _checked(left: DataFrame, right: DataFrame, shared: Sequence[str]) -> None:
    if clash := (set(left.columns) & set(right.columns)) - set(shared):
        raise ValueError(f"columns that both sides have: {', '.join(sorted(clash))}")


def asof_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], left_at: str, right_at: str, *, how: str = "left", strict: bool = False, tolerance: str | None = None, span: float = 86_400.0 * 30) -> DataFrame:
    """Each left row with the last right row of its keys at or before its moment (``strict``: before).

    Both sides are put together and sorted once by (keys, span of time), and the
    last right row is carried along: no row meets more than its neighbours. A
    key with many rows is cut into spans, and what a span begins with comes from
    a table of one row for each key and span. A null key or moment matches
    nothing. Of right rows of one moment the largest, by the other columns in
    turn, counts. ``tolerance`` is the longest time apart, such as "2 days".
    """
    keys = _list(on)
    _checked(left, right, keys)
    if how not in ("left", "inner"):
        raise ValueError("an as-of join is left or inner")
    kind = left.schema[left_at].dataType
    if right.schema[right_at].dataType != kind:
        raise TypeError(f"{left_at} and {right_at} differ in type")
    values = [c for c in right.columns if c not in keys]
    after = [right_at, *(c for c in values if c != right_at)]
    known = lambda at: F.col(f"`{at}`").isNotNull() & ~F.greatest(*(F.col(f"`{k}`").isNull() for k in keys), F.lit(False))
    r = right.where(known(right_at)).select(*keys, F.struct(*(F.col(f"`{c}`") for c in after)).alias("_right"), F.col(f"`{right_at}`").alias("_at")).withColumn("_span", _span(F.col("_at"), kind, span))
    # rows that can match nothing are of no span, each by itself
    l = left.select(*keys, F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_left"), F.col(f"`{left_at}`").alias("_at"), known(left_at).alias("_known"))  # noqa: E741
    l = l.withColumns({"_span": F.when(F.col("_known"), _span(F.col("_at"), kind, span)), "_deal": F.when(~F.col("_known"), F.xxhash64("_left")).otherwise(0)})  # noqa: E741
    ends = r.groupBy(*keys, "_span").agg(F.max("_right").alias("_right"))
    spans = ends.unionByName(l.where("_known").select(*keys, "_span").distinct(), allowMissingColumns=True).groupBy(*keys, "_span").agg(F.max("_right").alias("_right"))
    before = W.partitionBy(*keys).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    carried = spans.withColumn("_right", F.last("_right", ignorenulls=True).over(before)).where("_right IS NOT NULL").withColumn("_turn", F.lit(-1))
    rows = l.withColumn("_turn", F.lit(0 if strict else 2)).unionByName(r.withColumn("_turn", F.lit(1)), allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    rows = rows.withColumn("_deal", F.coalesce("_deal", F.lit(0)))
    # what is carried over comes first, whatever the moments of the span
    along = W.partitionBy(*keys, "_span", "_deal").orderBy((F.col("_turn") >= 0), "_at", "_turn", "_right").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_right", F.last("_right", ignorenulls=True).over(along)).where("_left IS NOT NULL")
    hit = F.col("_known")
    if tolerance is not None:
        least = F.col("_at") - (F.expr(f"INTERVAL {tolerance}") if not isinstance(kind, T.NumericType) else F.lit(float(tolerance)))
        hit = hit & (F.col(f"_right.`{right_at}`") >= least)
    found = found.withColumn("_right", F.when(hit, F.col("_right")))
    if how == "inner":
        found = found.where("_right IS NOT NULL")
    return found.select("_left.*", *(F.col(f"_right.`{c}`").alias(c) for c in values))


def interval_join(left: DataFrame, right: DataFrame, at: str, start: str, end: str, *, on: str | Sequence[str] = (), span: float = 86_400.0) -> DataFrame:
    """Left rows with all right rows whose interval [start, end) holds their moment and whose keys, if any, are equal.

    An interval goes to each span of time that it touches and a moment to its
    own, so that this is a join on equal spans; choose spans about as long as
    intervals. Empty intervals and nulls match nothing.
    """
    keys = _list(on)
    _checked(left, right, keys)
    kind = left.schema[at].dataType
    if any(right.schema[c].dataType != kind for c in (start, end)):
        raise TypeError(f"{at}, {start} and {end} differ in type")
    first, last = (_span(F.col(f"`{c}`"), kind, span) for c in (start, end))
    pieces = right.where(F.col(f"`{start}`") < F.col(f"`{end}`")).withColumn("_span", F.explode(F.sequence(first, last)))
    moments = left.withColumn("_span", _span(F.col(f"`{at}`"), kind, span))
    inside = (F.col(f"`{at}`") >= F.col(f"`{start}`")) & (F.col(f"`{at}`") < F.col(f"`{end}`"))
    return moments.join(pieces, [*keys, "_span"]).where(inside).drop("_span")
