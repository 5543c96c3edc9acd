"""Key-aligned joins. Sides are never broadcast by hand: the optimiser does it for a side whose size it knows."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import types as ty

log = logging.getLogger(__name__)


def _list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def left_join(left: DataFrame, right: DataFrame, left_on: str | Sequence[str], right_on: str | Sequence[str] | None = None, *, schema: Mapping[str, str] | None = None, how: str = "left", suffixes: tuple[str, str] = ("_x", "_y"), persist: bool = False, dry_run: bool = False, diagnostics: bool = False) -> DataFrame | str:
    """Equi-join on one or several keys, coerced to ``schema`` first; null keys match nothing.

    Keys of one name on both sides come once. Other columns of a name that both
    sides have get the suffixes. With ``dry_run`` the result is the plan's text.
    """
    l_on, r_on = _list(left_on), _list(right_on if right_on is not None else left_on)
    if len(l_on) != len(r_on):
        raise ValueError("as many keys are needed on either side")
    if schema:
        left, right = ty.align_for_join(left, right, schema)
    for a, b in zip(l_on, r_on, strict=True):
        if left.schema[a].dataType != right.schema[b].dataType and (wide := ty.widened(left.schema[a].dataType, right.schema[b].dataType)) is None:
            raise ty.SchemaValidationError(f"{a} and {b} differ in type; give a schema for them")
    shared = {a for a, b in zip(l_on, r_on, strict=True) if a == b}
    clash = (set(left.columns) & set(right.columns)) - shared
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    l_on = [c + suffixes[0] if c in clash else c for c in l_on]
    names = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    right = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    condition = [F.col(f"`{a}`") == F.col(names[b]) for a, b in zip(l_on, r_on, strict=True)]
    out = left.join(right, condition, how)
    kept = [c for c in names if c not in shared]
    if how in ("right", "outer", "full", "fullouter"):
        left_side = [F.coalesce(f"`{c}`", names[c]).alias(c) if c in shared else F.col(f"`{c}`") for c in left.columns]
    else:
        left_side = [F.col(f"`{c}`") for c in left.columns]
    out = out.select(*left_side, *(F.col(names[c]).alias(c + suffixes[1] if c in clash else c) for c in kept))
    if diagnostics:
        log.info("left join on %s", l_on)
    if dry_run:
        return out._jdf.queryExecution().toString()
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


def indexed_left_join(left: DataFrame, right: DataFrame, on: str, *, partitions: int | None = None) -> DataFrame:
    """Left join on one key with both sides dealt by it, for several joins on the same key in a row."""
    if clash := (set(left.columns) & set(right.columns)) - {on}:
        raise ValueError(f"columns that both sides have: {', '.join(sorted(clash))}")
    deal = (lambda df: df.repartition(partitions, on)) if partitions else (lambda df: df.repartition(on))
    return deal(left).join(deal(right), on, "left")


def hot_keys(df: DataFrame, on: str, share: float = 0.01) -> list:
    """The keys that more than a ``share`` of all rows have: fewer than 1 / share. Counts are reduced before they are shuffled."""
    counts = df.where(F.col(f"`{on}`").isNotNull()).groupBy(F.col(f"`{on}`").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    total = df.count()
    return [r.k for r in counts.where(F.col("n") > share * total).collect()]


def hot_key_join(left: DataFrame, right: DataFrame, on: str, *, how: str = "left", share: float = 0.01, salt: int = 32) -> DataFrame:
    """Join on one key of which few values may have most of the left rows.

    Left rows of such a key, and those of null, are dealt over ``salt`` tasks;
    the right rows of the same keys, and no others, go to all of them. All
    other keys are joined as ever. A null key matches nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError("a join of hot keys is left or inner")
    if clash := (set(left.columns) & set(right.columns)) - {on}:
        raise ValueError(f"columns that both sides have: {', '.join(sorted(clash))}")
    hot = hot_keys(left, on, share)
    c = F.col(f"`{on}`")
    many = F.array(*(F.lit(k) for k in range(salt)))
    # any number does for a left row, as all have the right rows
    number = F.pmod(F.monotonically_increasing_id(), F.lit(salt)).cast("int")
    dealt = left.withColumn("_salt", F.when(c.isin(*hot) | c.isNull() if hot else c.isNull(), number).otherwise(0))
    copies = right.withColumn("_salt", F.explode(F.when(c.isin(*hot), many).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def _keys(keys: DataFrame | Sequence, df: DataFrame, on: str) -> DataFrame:
    if isinstance(keys, DataFrame):
        return keys.select(F.col(f"`{keys.columns[0]}`").alias(on))
    kind = df.schema[on].dataType
    return df.sparkSession.createDataFrame([(k,) for k in keys], f"`{on}` {kind.simpleString()}")


def semi_join(df: DataFrame, keys: DataFrame | Sequence, on: str, *, nulls: bool = False) -> DataFrame:
    """The rows whose key is among ``keys`` (a frame's first column or a list); ``nulls`` lets null match null."""
    k = _keys(keys, df, on)
    if not nulls:
        return df.join(k, on, "left_semi")
    k = k.withColumnRenamed(on, "_key")
    return df.join(k, F.col(f"`{on}`").eqNullSafe(F.col("_key")), "left_semi")


def anti_join(df: DataFrame, keys: DataFrame | Sequence, on: str, *, nulls: bool = False) -> DataFrame:
    """The rows whose key isn't among ``keys``; a null key stays, unless ``nulls`` lets null match null."""
    k = _keys(keys, df, on).withColumnRenamed(on, "_key")
    c = F.col(f"`{on}`")
    return df.join(k, c.eqNullSafe(F.col("_key")) if nulls else c == F.col("_key"), "left_anti")


def string_key_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, drop: Sequence[str] = ()) -> DataFrame:
    """Left join of keys as text, as attachments are merged."""
    names = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    r = right.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    out = left.join(r, F.col(f"`{left_on}`").cast("string") == F.col(names[right_on]).cast("string"), "left")
    own = [c for c in right.columns if c not in drop and not (c == right_on and right_on in left.columns)]
    if clash := set(own) & set(left.columns):
        raise ValueError(f"columns that both sides have: {', '.join(sorted(clash))}")
    return out.select(*(F.col(f"`{c}`") for c in left.columns if c not in drop), *(F.col(names[c]).alias(c) for c in own))
