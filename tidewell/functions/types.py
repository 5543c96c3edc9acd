"""Declared column types: aliases, coercion to null, validation and alignment."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Dtype names and the Spark types they stand for.
ALIASES: dict[str, T.DataType] = {
    "int": T.LongType(),
    "int64": T.LongType(),
    "integer": T.LongType(),
    "bigint": T.LongType(),
    "long": T.LongType(),
    "int32": T.IntegerType(),
    "int16": T.ShortType(),
    "smallint": T.ShortType(),
    "int8": T.ByteType(),
    "float": T.DoubleType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "float32": T.FloatType(),
    "bool": T.BooleanType(),
    "boolean": T.BooleanType(),
    "str": T.StringType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "object": T.StringType(),
    "category": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampType(),
    "binary": T.BinaryType(),
}
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes", "y", "t"), ("false", "0", "no", "n", "f")


class SchemaValidationError(ValueError):
    """A frame doesn't have the declared columns or types."""


def parse_type(name: str | T.DataType) -> T.DataType:
    """The Spark type of a dtype name; units of datetimes don't matter, a zone does."""
    if isinstance(name, T.DataType):
        return name
    low = name.strip().lower()
    if low.startswith(("datetime64", "timestamp[")):
        return T.TimestampType() if "utc" in low or "tz" in low else T.TimestampNTZType()
    low = low.split("[")[0]
    if low in ALIASES:
        return ALIASES[low]
    try:
        return T.DataType.fromDDL(name)
    except Exception as e:
        raise ValueError(f"unknown type {name!r}") from e


def coerce(column: Column, source: T.DataType, target: str | T.DataType) -> Column:
    """``column`` as ``target``, null where its value can't be one."""
    target = parse_type(target)
    if source == target:
        return column
    text = isinstance(source, T.StringType)
    if text:
        column = F.nullif(F.trim(column), F.lit(""))
    if isinstance(target, T.BooleanType) and not isinstance(source, T.BooleanType):
        word = F.lower(column.cast("string"))
        number = column.try_cast("double") if text else column.cast("double")
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False).when(number.isNotNull(), number != 0)
    if isinstance(target, T.IntegralType) and text:
        # "3.7" is no integer literal, but a number; whole texts keep all their digits
        return F.coalesce(column.try_cast(target), column.try_cast("double").try_cast(target))
    return column.try_cast(target)


def infer_schema_map(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def apply_schema_map(df: DataFrame, schema: Mapping[str, str | T.DataType]) -> DataFrame:
    """Declared columns that exist, coerced; others are as they were."""
    return df.withColumns({c: coerce(F.col(f"`{c}`"), df.schema[c].dataType, t) for c, t in schema.items() if c in df.columns})


def validate_schema(df: DataFrame, schema: Mapping[str, str | T.DataType], *, strict: bool = False) -> DataFrame:
    """``df`` if it has the declared columns with their types, and with ``strict`` no others."""
    wrong = [f"{c}: missing" for c in schema if c not in df.columns]
    wrong += [f"{c}: {df.schema[c].dataType.simpleString()} is not {parse_type(t).simpleString()}" for c, t in schema.items() if c in df.columns and df.schema[c].dataType != parse_type(t)]
    if strict:
        wrong += [f"{c}: not declared" for c in df.columns if c not in schema]
    if wrong:
        raise SchemaValidationError("; ".join(wrong))
    return df


def align_for_join(left: DataFrame, right: DataFrame, schema: Mapping[str, str | T.DataType]) -> tuple[DataFrame, DataFrame]:
    return apply_schema_map(left, schema), apply_schema_map(right, schema)


def assume_zone(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Columns of local times as instants, each read in its zone."""
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, T.TimestampNTZType)]
    if wrong:
        raise SchemaValidationError(f"not local times: {', '.join(wrong)}")
    local = lambda c, zone: F.convert_timezone(F.lit(zone), F.current_timezone(), F.col(f"`{c}`")).cast("timestamp")
    return df.withColumns({c: local(c, zone) for c, zone in columns.items()})


# ---------------------------------------------------------------- widening
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def widened(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both fit in, or None."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    x, y = a.simpleString(), b.simpleString()
    if x in _NUMBERS and y in _NUMBERS:
        wide = max(x, y, key=_NUMBERS.index)
        if wide == "float" and min(x, y, key=_NUMBERS.index) in ("int", "bigint"):
            wide = "double"
        return parse_type({"tinyint": "int8", "smallint": "int16", "int": "int32", "float": "float32"}.get(wide, wide))
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return max((a, b), key=lambda t: times.index(type(t)))
    return None


def union_widened(*frames: DataFrame, stringify: bool = True, columns: str = "all") -> DataFrame:
    """All rows by column name; a column has the type its frames' types widen to, or text, and is null where a frame lacks it.

    ``columns`` is "all", "common" (those that all frames have) or "same" (all have the same, or it is an error).
    """
    if columns not in ("all", "common", "same"):
        raise ValueError("columns are all, common or same")
    if columns == "same" and any(set(df.columns) != set(frames[0].columns) for df in frames):
        raise SchemaValidationError("the frames' columns differ")
    if columns == "common":
        frames = tuple(df.select(*(f"`{c}`" for c in frames[0].columns if all(c in x.columns for x in frames))) for df in frames)
    types: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            t = widened(types[f.name], f.dataType) if f.name in types else f.dataType
            if t is None and not stringify:
                raise SchemaValidationError(f"{f.name}: {types[f.name].simpleString()} and {f.dataType.simpleString()} don't widen")
            types[f.name] = t or T.StringType()
    cast = [df.select(*(F.col(f"`{c}`").cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in types.items())) for df in frames]
    out = cast[0]
    for df in cast[1:]:
        out = out.unionByName(df)
    return out
