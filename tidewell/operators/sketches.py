"""Aggregates that add up: distinct counts and quantiles kept as sketches, so that increments are merged and old rows aren't read again.

A sketch is small and its counts are estimates. Where a distinct count has to
be exact, ``tallied`` keeps each group's values and how often they were there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sizes of sketches. A distinct count's standard error is 1.04 / 2^(LG_K / 2), 0.4 % here (counts up to
#: some thousands are all but exact); a quantile's rank is off by about 1.7 / K, 0.1 %, with 99 % confidence.
LG_K, K = 16, 2_000


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _hashable(c: str, kind: T.DataType) -> Column:
    """A column as one that a distinct count takes: whole numbers, texts and bytes as they are, others as text."""
    column = F.col(f"`{c}`")
    return column if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else column.cast("string")


def sketched(df: DataFrame, keys: str | Sequence[str], *, distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """A row a group: ``_rows``, ``_distinct_<column>`` and ``_quantiles_<column>``, some KB each at most, however many rows. Nulls aren't counted."""
    made = [F.count(F.lit(1)).alias("_rows")]
    made += [F.hll_sketch_agg(_hashable(c, df.schema[c].dataType), LG_K).alias(f"_distinct_{c}") for c in distinct]
    made += [F.kll_sketch_agg_double(F.col(f"`{c}`").cast("double"), K).alias(f"_quantiles_{c}") for c in quantiles]
    return df.groupBy(*(f"`{k}`" for k in _list(keys))).agg(*made)


def merged(keys: str | Sequence[str], *parts: DataFrame) -> DataFrame:
    """The sketches of all parts, as if their rows had been sketched together."""
    every = reduce(DataFrame.unionByName, parts)
    made = []
    for c in every.columns:
        if c == "_rows":
            made.append(F.sum(c).alias(c))
        elif c.startswith("_distinct_"):
            made.append(F.hll_union_agg(c).alias(c))
        elif c.startswith("_quantiles_"):
            made.append(F.kll_merge_agg_double(c, K).alias(c))
    return every.groupBy(*(f"`{k}`" for k in _list(keys))).agg(*made)


def estimates(df: DataFrame, quantiles: Mapping[str, float] | None = None) -> DataFrame:
    """What sketches tell: the group's keys, ``rows``, ``<column>_nunique``, and a column for each name of ``quantiles`` and sketched column."""
    out: list[Column] = []
    for c in df.columns:
        if c == "_rows":
            out.append(F.col(c).alias("rows"))
        elif c.startswith("_distinct_"):
            out.append(F.hll_sketch_estimate(c).alias(f"{c.removeprefix('_distinct_')}_nunique"))
        elif c.startswith("_quantiles_"):
            name = c.removeprefix("_quantiles_")
            out += [F.when(F.kll_sketch_get_n_double(c) > 0, F.kll_sketch_get_quantile_double(c, F.lit(float(q)))).alias(f"{name}_{title}") for title, q in (quantiles or {"median": 0.5}).items()]
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


# --------------------------------------------------------------------- exact
def tallied(df: DataFrame, keys: str | Sequence[str], column: str) -> DataFrame:
    """A row (keys, column, ``_rows``) a group and distinct value; null is a value here."""
    return df.groupBy(*(f"`{k}`" for k in _list(keys)), f"`{column}`").agg(F.count(F.lit(1)).alias("_rows"))


def added(keys: str | Sequence[str], column: str, *parts: DataFrame) -> DataFrame:
    """The tallies of all parts, as if their rows had been tallied together."""
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*(f"`{k}`" for k in _list(keys)), f"`{column}`").agg(F.sum("_rows").alias("_rows"))


def exact(tally: DataFrame, keys: str | Sequence[str], column: str) -> DataFrame:
    """A row a group: its keys, ``rows``, and ``<column>_nunique``, the exact count of distinct values that aren't null, of an added tally."""
    return tally.groupBy(*(f"`{k}`" for k in _list(keys))).agg(F.sum("_rows").alias("rows"), F.count(f"`{column}`").alias(f"{column}_nunique"))
