"""Shaping after a load: selection, sorting, duplicates and grouping."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)


def select_fields(df: DataFrame, names: Sequence[str] | None) -> DataFrame:
    """The named columns that exist; all, if none does."""
    if not names:
        return df
    there = [n for n in names if n in df.columns]
    if gone := [n for n in names if n not in df.columns]:
        log.warning("columns that don't exist are skipped: %s", ", ".join(gone))
    return df.select(*(f"`{n}`" for n in there)) if there else df


def with_columns(df: DataFrame, expressions: Mapping[str, Column | str]) -> DataFrame:
    """Columns added or replaced, all from the columns there were."""
    return df.withColumns({k: F.expr(v) if isinstance(v, str) else v for k, v in expressions.items()})


def sort(df: DataFrame, by: str | Sequence[str | tuple[str, str]]) -> DataFrame:
    """Ordered rows, nulls last either way; an entry may be (column, "descending")."""
    keys = [by] if isinstance(by, str) else by
    order = []
    for key in keys:
        name, way = (key, "ascending") if isinstance(key, str) else key
        c = F.col(f"`{name}`")
        order.append(c.desc_nulls_last() if way.startswith("desc") else c.asc_nulls_last())
    return df.orderBy(*order)


def top(df: DataFrame, by, n: int) -> DataFrame:
    """The first ``n`` rows of an order: each task keeps as many and no more."""
    return sort(df, by).limit(n)


def deduplicate(df: DataFrame, subset: str | Sequence[str] | None = None, keep: str | bool = "last", order_by: str | Sequence[str] | None = None) -> DataFrame:
    """One row of each key: the first or last in an order, or with ``keep=False`` the rows whose key occurs once.

    Rows of a distributed table have no order of their own: without
    ``order_by`` all other columns, in their order, make one. The first and
    last are aggregates of a struct, so that a key with most of the rows is
    reduced in each task before it is shuffled.
    """
    keys = list(df.columns) if subset is None else [subset] if isinstance(subset, str) else list(subset)
    if keep not in ("first", "last", False):
        raise ValueError("keep is 'first', 'last' or False")
    columns = df.columns
    quoted = [F.col(f"`{k}`") for k in keys]
    packed = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    if keep is False:
        out = df.groupBy(*(q.alias(f"_k{i}") for i, q in enumerate(quoted))).agg(F.count("*").alias("_n"), F.first(packed).alias("_row")).where("_n = 1")
        return out.select("_row.*")
    rest = [c for c in columns if c not in keys]
    lead = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    order = [*lead, *(c for c in rest if c not in lead and _ordered(df.schema[c].dataType))]
    if not order:
        return df.dropDuplicates(keys)
    # nulls come last in an order: a flag goes before each value
    rank = F.struct(*(x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
    pick = (F.min_by if keep == "first" else F.max_by)(packed, rank)
    return df.groupBy(*(q.alias(f"_k{i}") for i, q in enumerate(quoted))).agg(pick.alias("_row")).select("_row.*")


def _ordered(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.MapType, T.VariantType))


def _any(c: str, kind: T.DataType) -> Column:
    column = F.col(f"`{c}`")
    return F.bool_or(column) if isinstance(kind, T.BooleanType) else F.bool_or(column != F.lit(0 if isinstance(kind, T.NumericType) else "").cast(kind))


#: Aggregates by name.
AGGREGATES = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
    "len": lambda _: F.count(F.lit(1)),
    "size": lambda _: F.count(F.lit(1)),
    "nunique": F.count_distinct,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "median": F.median,
    "list": F.collect_list,
}


def group(df: DataFrame, keys: str | Sequence[str], aggregates: str | Mapping[str, str | Sequence[str]], order_by: str | Sequence[str] | None = None, *, suffix: bool = False) -> DataFrame:
    """Grouped aggregates: a name for every other column, or column to name or names.

    One aggregate of a column keeps the column's name; several (or ``suffix``)
    are called ``column_name``. Null keys are a group. ``first`` and ``last``
    follow ``order_by``, or the order of all other columns.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if isinstance(aggregates, str):
        aggregates = {c: aggregates for c in df.columns if c not in keys}
    lead = [] if order_by is None else [order_by] if isinstance(order_by, str) else list(order_by)
    out = []
    for column, names in aggregates.items():
        several = [names] if isinstance(names, str) else list(names)
        for name in several:
            title = f"{column}_{name}" if suffix or len(several) > 1 else column
            if name in ("first", "last"):
                order = [*lead, *(c for c in df.columns if c not in lead and c not in keys and _ordered(df.schema[c].dataType))]
                rank = F.struct(*(x for c in order for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))))
                made = (F.min_by if name == "first" else F.max_by)(F.col(f"`{column}`"), rank)
            elif name == "any":
                made = _any(column, df.schema[column].dataType)
            elif name in AGGREGATES:
                made = AGGREGATES[name](F.col(f"`{column}`"))
            else:
                raise ValueError(f"{name!r}: no such aggregate")
            out.append(made.alias(title))
    return df.groupBy(*(f"`{k}`" for k in keys)).agg(*out)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(f"`{column}`").agg(F.count(F.lit(1)).alias("count"))


def distinct_values(df: DataFrame, column: str, most: int) -> list:
    """A column's distinct values that aren't null, or an error if they are more than ``most``."""
    got = df.select(f"`{column}`").where(F.col(f"`{column}`").isNotNull()).distinct().limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return [r[0] for r in got]


def bounded_count(df: DataFrame, most: int) -> int:
    """The number of rows, or ``most`` + 1 if there are more."""
    return df.limit(most + 1).count()


def bounds(df: DataFrame, column: str) -> tuple:
    return tuple(df.agg(F.min(f"`{column}`"), F.max(f"`{column}`")).first())


