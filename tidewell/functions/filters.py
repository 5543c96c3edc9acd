"""The keyword filter language: ``field__op``, ``field__cast__op`` and ``$and $or $not``.

A filter dict becomes one Column, so that Catalyst pushes to the scan what a
scan can take and evaluates the rest. Logic is SQL's three-valued one: a
comparison with null is neither true nor false, and such rows are dropped.

A text column is compared as text, with the value's text. The values of a list
are made ones of the column's type first, the same way for any length and for a
frame of values: what nothing of that type equals (7.5 for integers, a time of
day for dates) is in no list.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from decimal import Decimal, localcontext
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import types as ty

# The operators and casts of the language.
OPERATORS = ("exact", "not_exact", "gt", "gte", "lt", "lte", "in", "not_in", "range", "contains", "not_contains", "startswith", "endswith", "isnull", "icontains", "istartswith", "iendswith", "iexact", "regex", "iregex")
SHORT = {"ne": "not_exact", "nin": "not_in"}
CASTS = ("date", "time", "year", "month", "day", "hour", "minute", "second", "week_day")
LONGEST_PATTERN = 500
#: Lists beyond so many values are joined with instead of written into the plan; the rows are the same.
LONG_LIST = 5_000


class FilterError(ValueError):
    """A filter that can't be understood."""


# ---------------------------------------------------------------------- tree
class Expr:
    def __and__(self, other: Expr) -> Expr:
        return And((self, other))

    def __or__(self, other: Expr) -> Expr:
        return Or((self, other))

    def __invert__(self) -> Expr:
        return Not(self)


@dataclass(frozen=True)
class TrueExpr(Expr):
    pass


@dataclass(frozen=True)
class ColOp(Expr):
    column: str
    op: str
    value: Any
    cast: str | None = None


@dataclass(frozen=True)
class Joined(Expr):
    """A membership whose values were joined with: ``mark`` is set where one matched, ``key`` is what was compared, and ``some`` tells whether there are any (None: there are)."""

    op: str
    key: Column
    mark: str
    nulls: bool
    some: Column | None


@dataclass(frozen=True)
class And(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple[Expr, ...]


@dataclass(frozen=True)
class Not(Expr):
    part: Expr


# ------------------------------------------------------------------- parsing
def parse_key(key: str, columns: Iterable[str] | None = None) -> tuple[str, str | None, str]:
    """(field, cast, operator) of a key; a field may hold ``__`` where a column does."""
    known = set(columns or ())
    parts = key.split("__")
    for n in range(len(parts), 0, -1) if known else (1,):
        field = "__".join(parts[:n])
        if known and field not in known and n > 1:
            continue
        if (tail := _tail(parts[n:])) is not None:
            return (field, *tail)
    raise FilterError(f"{key!r}: no such operator or cast")


def _tail(rest: list[str]) -> tuple[str | None, str] | None:
    cast = None
    if rest and rest[0] in CASTS:
        cast, rest = rest[0], rest[1:]
    if rest[:1] == ["not"] and len(rest) == 2:
        op = f"not_{rest[1]}"
    elif len(rest) > 1:
        return None
    else:
        op = rest[0] if rest else "exact"
    op = SHORT.get(op, op)
    return (cast, op) if op in OPERATORS else None


def parse(filters: Mapping[str, Any] | Expr | None, columns: Iterable[str] | None = None) -> Expr:
    """The tree of a filter dict; all its entries must hold. An empty dict holds for every row."""
    if filters is None:
        return TrueExpr()
    if isinstance(filters, Expr):
        return filters
    found: list[Expr] = []
    for key, value in filters.items():
        if key in ("$and", "$or"):
            if not isinstance(value, (list, tuple)) or not value:
                raise FilterError(f"{key} takes a list of at least one filter")
            parts = tuple(parse(v, columns) for v in value)
            found.append(And(parts) if key == "$and" else Or(parts))
        elif key == "$not":
            found.append(Not(parse(value, columns)))
        elif key.startswith("$"):
            raise FilterError(f"{key!r}: no such node")
        else:
            field, cast, op = parse_key(key, columns)
            found.append(ColOp(field, op, value, cast))
    return TrueExpr() if not found else found[0] if len(found) == 1 else And(tuple(found))


def parse_tuples(raw: Iterable) -> Expr:
    """A tree of (column, operator, value) tuples, or of a list of lists of them (any of which holds)."""
    symbols = {"=": "exact", "==": "exact", "!=": "not_exact", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "in": "in", "not in": "not_in"}
    raw = list(raw)
    if raw and isinstance(raw[0], list):
        return Or(tuple(parse_tuples(r) for r in raw))
    found = []
    for column, symbol, value in raw:
        if symbol not in symbols:
            raise FilterError(f"{symbol!r}: no such operator")
        found.append(ColOp(column, symbols[symbol], value))
    return And(tuple(found)) if found else TrueExpr()


def check_pattern(pattern: str) -> str:
    """The pattern, if it compiles, isn't too long and has no quantifier on a quantified group."""
    if not isinstance(pattern, str) or len(pattern) > LONGEST_PATTERN:
        raise FilterError(f"a pattern is text of up to {LONGEST_PATTERN} characters")
    try:
        re.compile(pattern)
    except re.error as e:
        raise FilterError(f"{pattern!r}: {e}") from e
    if re.search(r"\((?:[^()\\]|\\.)*[*+}](?:[^()\\]|\\.)*\)\s*[*+{]", pattern):
        raise FilterError(f"{pattern!r}: nested quantifiers")
    return pattern


# ----------------------------------------------------------------- compiling
def _literal(value: Any, kind: T.DataType | None) -> Column:
    """A value as a literal of the column's type, for temporal columns; a text column is compared with the value's text."""
    if isinstance(kind, T.StringType) and value is not None:
        return F.lit(_text(value))
    if isinstance(kind, T.DateType):
        if isinstance(value, dt.datetime):
            return F.lit(value).cast("timestamp_ntz")
        return F.lit(str(value)).cast("date") if isinstance(value, str) and len(value) <= 10 else F.lit(value).cast("timestamp_ntz") if isinstance(value, str) else F.lit(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        name = "timestamp" if isinstance(kind, T.TimestampType) else "timestamp_ntz"
        if isinstance(value, dt.datetime) and value.tzinfo and name == "timestamp_ntz":
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        if isinstance(value, (dt.datetime, dt.date)):
            return F.lit(value.isoformat()).cast(name)
        return F.lit(value).cast(name)
    return F.lit(value)


def _text(value: Any) -> str:
    """A value's text as a cast to text has it."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, dt.datetime):
        return value.isoformat(" ").rstrip("0").rstrip(".") if value.microsecond and not value.tzinfo else value.isoformat(" ")
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, float) and math.isfinite(value) and value and not 1e-3 <= abs(value) < 1e7:
        sign, digits, _ = Decimal(repr(value)).normalize().as_tuple()
        tail = "".join(map(str, digits[1:])) or "0"
        return f"{'-' if sign else ''}{digits[0]}.{tail}E{Decimal(repr(value)).adjusted()}"
    return str(value)


# --------------------------------------------------------------- memberships
def _moment(value: Any) -> dt.datetime | None:
    """A date, time or text of one as a local time; dates are midnights."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    if isinstance(value, str):
        if short := re.fullmatch(r"\s*(\d{4})-(\d{1,2})-(\d{1,2})\s*", value):
            value = "{:0>4}-{:0>2}-{:0>2}".format(*short.groups())
        try:
            return dt.datetime.fromisoformat(value.strip())
        except ValueError as e:
            raise FilterError(f"{value!r} is no date or time") from e
    return None


def _member(value: Any, kind: T.DataType) -> Any:
    """A list's value as one of the column's type, or None if no value of that type equals it."""
    if isinstance(kind, T.StringType):
        return _text(value)
    if isinstance(kind, T.DateType):
        moment = _moment(value)
        return None if moment is None or moment.time() != dt.time() else moment.date()
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        moment = _moment(value)
        if moment is not None and moment.tzinfo and isinstance(kind, T.TimestampNTZType):
            moment = moment.astimezone(dt.UTC).replace(tzinfo=None)
        return moment
    if isinstance(kind, T.BooleanType):
        if isinstance(value, str):
            word = value.strip().lower()
            return True if word in ty.TRUE_WORDS else False if word in ty.FALSE_WORDS else None
        return bool(value) if value in (0, 1) else None
    if isinstance(kind, T.NumericType):
        if isinstance(value, (dt.date, dt.time)):
            return None
        try:
            exact = value if isinstance(value, (int, float)) else Decimal(str(value).strip())
            if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
                return float(exact)
            exact = Decimal(repr(exact)) if isinstance(exact, float) else Decimal(exact)
        except ArithmeticError as e:
            raise FilterError(f"{value!r} is no number") from e
        if not exact.is_finite():
            return None
        with localcontext(prec=100):
            if isinstance(kind, T.DecimalType):
                return exact if exact == round(exact, kind.scale) and abs(exact) < Decimal(10) ** (kind.precision - kind.scale) else None
            return int(exact) if exact == exact.to_integral_value() and abs(exact) < 2**63 else None
    return value


def _members_of(values: Iterable, cast: str | None, kind: T.DataType | None) -> list:
    """The distinct values of a list that something of the column's type (after the cast) can equal; the same for any length."""
    plain = [v for v in values if v is not None]
    if cast == "date":
        plain = list(map(_date, plain))
    elif cast:
        plain = [_seconds(v) if cast == "time" else int(v) for v in plain]
    elif kind is not None:
        plain = [m for m in (_member(v, kind) for v in plain) if m is not None]
    return list(dict.fromkeys(plain))


def _member_literal(value: Any, kind: T.DataType | None) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value)


def _frame_members(c: Column, own: T.DataType, kind: T.DataType) -> Column:
    """A frame's value as one of the column's type by the rules of lists, or null if it equals none."""
    numbers = isinstance(own, T.NumericType)
    if own == kind or isinstance(own, T.IntegralType) and isinstance(kind, T.IntegralType):
        return c
    if isinstance(kind, T.StringType):
        return c.cast("string")
    if isinstance(kind, T.BooleanType):
        return F.when(c == 1, True).when(c == 0, False) if numbers else ty.coerce(c, own, kind)
    if isinstance(kind, T.DateType):
        at = c.try_cast("timestamp_ntz")
        return F.when(at == F.to_date(at).cast("timestamp_ntz"), F.to_date(at))
    if isinstance(kind, T.NumericType):
        if isinstance(own, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.lit(None).cast(kind)
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            return F.trim(c).try_cast("double") if not numbers else c.cast("double")
        exact = c if numbers else F.trim(c).try_cast("decimal(38,10)")
        own_kind = exact.try_cast(kind)
        return F.when(own_kind == exact, own_kind)
    return c.try_cast(kind)


def _seconds(value: Any) -> int:
    if isinstance(value, dt.datetime):
        value = value.time()
    if isinstance(value, dt.time):
        return value.hour * 3600 + value.minute * 60 + value.second
    if isinstance(value, str):
        return _seconds(dt.time.fromisoformat(value))
    return int(value)


def _date(value: Any) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)[:10])


def _cast(column: Column, cast: str, kind: T.DataType | None) -> Column:
    if isinstance(kind, T.StringType):
        column = column.try_cast("timestamp_ntz")
    if cast == "date":
        return F.to_date(column)
    if cast == "time":
        return F.hour(column) * 3600 + F.minute(column) * 60 + F.second(column)
    if cast == "week_day":
        return F.weekday(column)  # Monday is 0
    return getattr(F, "dayofmonth" if cast == "day" else cast)(column)


def _many(value: Any, what: str) -> list:
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        raise FilterError(f"{what} takes a list")
    return list(dict.fromkeys(value))


def _compare(c: Column, op: str, value: Any, lit, members) -> Column:
    if op == "exact":
        return c.isNull() if value is None else c == lit(value)
    if op == "not_exact":
        return c.isNotNull() if value is None else c != lit(value)
    if op in ("gt", "gte", "lt", "lte"):
        return {"gt": c > lit(value), "gte": c >= lit(value), "lt": c < lit(value), "lte": c <= lit(value)}[op]
    if op in ("in", "not_in"):
        values = _many(value, op)
        plain = members(values)
        # a list none of whose values can be met is still a list: what is null is in neither
        test = c.isin(*plain) if plain else F.when(c.isNotNull(), F.lit(False)) if any(v is not None for v in values) else F.lit(False)
        if op == "in":
            return test | c.isNull() if None in values else test
        return ~test & c.isNotNull() if None in values else ~test
    if op == "range":
        if isinstance(value, (str, bytes)) or not isinstance(value, Iterable) or len(ends := list(value)) != 2:
            raise FilterError("range takes two ends")
        return c.between(lit(ends[0]), lit(ends[1]))
    if op == "isnull":
        return c.isNull() if value else c.isNotNull()
    text = c.cast("string")
    if op in ("regex", "iregex"):
        return text.rlike(("(?i)" if op == "iregex" else "") + check_pattern(value))
    value = str(value)
    if op == "not_contains":
        return ~text.contains(F.lit(value))
    if op.startswith("i"):
        text, value, op = F.lower(text), value.lower(), op[1:]
    if op == "exact":
        return text == F.lit(value)
    return getattr(text, op)(F.lit(value))


def compile_expr(expr: Expr, schema: T.StructType) -> Column:
    """The Column of a tree over columns of ``schema``."""
    if isinstance(expr, TrueExpr):
        return F.lit(True)
    if isinstance(expr, Not):
        return ~compile_expr(expr.part, schema)
    if isinstance(expr, And):
        return reduce(lambda a, b: a & b, (compile_expr(p, schema) for p in expr.parts))
    if isinstance(expr, Or):
        return reduce(lambda a, b: a | b, (compile_expr(p, schema) for p in expr.parts))
    if isinstance(expr, Joined):
        unknown = expr.key.isNull() if expr.some is None else expr.key.isNull() & expr.some
        found = F.when(unknown, F.lit(None).cast("boolean")).otherwise(F.col(expr.mark).isNotNull())
        if expr.op == "in":
            return found | expr.key.isNull() if expr.nulls else found
        return ~found & expr.key.isNotNull() if expr.nulls else ~found
    if expr.column not in schema.names:
        raise FilterError(f"{expr.column!r}: no such column")
    kind, column = schema[expr.column].dataType, F.col(f"`{expr.column}`")
    if expr.cast is None:
        return _compare(column, expr.op, expr.value, lambda v: _literal(v, kind), lambda values: [_member_literal(v, kind) for v in _members_of(values, None, kind)])
    lit = (lambda v: F.lit(_date(v))) if expr.cast == "date" else (lambda v: F.lit(_seconds(v))) if expr.cast == "time" else (lambda v: F.lit(int(v)))
    return _compare(_cast(column, expr.cast, kind), expr.op, expr.value, lit, lambda values: [F.lit(v) for v in _members_of(values, expr.cast, kind)])


def _long(expr: Expr) -> bool:
    return isinstance(expr, ColOp) and (isinstance(expr.value, DataFrame) or expr.op in ("in", "not_in") and isinstance(expr.value, (list, tuple, set, frozenset)) and len(expr.value) > LONG_LIST)


def _members(df: DataFrame, leaf: ColOp) -> tuple[Column, DataFrame, bool]:
    """What a long membership compares, its distinct values as a frame of one column, and whether null is one of a list's."""
    if leaf.op not in ("in", "not_in"):
        raise FilterError(f"{leaf.column}: a frame of values goes with in or not_in")
    if leaf.column not in df.columns:
        raise FilterError(f"{leaf.column!r}: no such column")
    column, kind = F.col(f"`{leaf.column}`"), df.schema[leaf.column].dataType
    key = _cast(column, leaf.cast, kind) if leaf.cast else column
    kind = df.select(key).schema[0].dataType
    if isinstance(leaf.value, DataFrame):
        first = F.col(f"`{leaf.value.columns[0]}`")
        own = leaf.value.schema[0].dataType
        if leaf.cast and own != kind:
            first = _cast(first, leaf.cast, own)
        elif not leaf.cast:
            first = _frame_members(first, own, kind)
        return key, leaf.value.select(first.alias("_member")).where("_member IS NOT NULL").distinct(), False
    plain = _members_of(leaf.value, leaf.cast, kind)
    times = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and not leaf.cast
    values = [v.isoformat() for v in plain] if times else plain
    given = df.sparkSession.createDataFrame(pa.table({"_member": pa.array(values) if values else pa.array([], pa.string())}))
    return key, given.select(F.col("_member").cast(kind)) if times or not values else given, None in leaf.value


def _joined(df: DataFrame, expr: Expr) -> tuple[DataFrame, Expr]:
    """``df`` with a mark for each long membership of the tree, and the tree over those marks."""
    if _long(expr):
        key, given, nulls = _members(df, expr)
        mark = "_mark"
        while mark in df.columns:
            mark = "_" + mark
        some = given.exists() if isinstance(expr.value, DataFrame) else None
        given = given.select(F.col("_member").alias(mark))
        return df.join(given, key == F.col(mark), "left"), Joined(expr.op, key, mark, nulls, some)
    if isinstance(expr, Not):
        df, part = _joined(df, expr.part)
        return df, Not(part)
    if isinstance(expr, (And, Or)):
        parts = []
        for p in expr.parts:
            df, part = _joined(df, p)
            parts.append(part)
        return df, type(expr)(tuple(parts))
    return df, expr


def apply(df: DataFrame, filters: Mapping[str, Any] | Expr | None = None, *, exclude: bool = False, **more: Any) -> DataFrame:
    """The rows for which all filters hold, or with ``exclude`` for which they are false.

    A membership in a frame's first column (nulls there match nothing) or in a
    long list is a join: a semi- or anti-join where it has to hold by itself,
    else a left join that marks the rows, so that it may stand anywhere in a
    tree.
    """
    expr = parse(filters, df.columns)
    if more:
        expr = parse(more, df.columns) if isinstance(expr, TrueExpr) else And((expr, parse(more, df.columns)))
    if exclude:
        expr = Not(expr)
    columns = df.columns
    parts = _conjuncts(expr)
    rest = [p for p in parts if not _long(p)]
    if rest:
        marked, expr = _joined(df, rest[0] if len(rest) == 1 else And(tuple(rest)))
        if not isinstance(expr, TrueExpr):
            df = marked.where(compile_expr(expr, marked.schema))
            df = df.select(*(F.col(f"`{c}`") for c in columns)) if df.columns != columns else df
    for leaf in parts:
        if _long(leaf):
            key, given, nulls = _members(df, leaf)
            if leaf.op == "not_in":
                # nothing is in an empty frame, and nothing is known of null and any other
                known = key.isNotNull() | ~given.exists() if isinstance(leaf.value, DataFrame) else key.isNotNull()
                df = df.where(known).join(given, key == F.col("_member"), "left_anti")
            else:
                if nulls:
                    given = given.unionByName(given.limit(0).groupBy().agg(F.max("_member").alias("_member")))
                df = df.join(given, key.eqNullSafe(F.col("_member")) if nulls else key == F.col("_member"), "left_semi")
    return df


def _conjuncts(expr: Expr) -> list[Expr]:
    return [x for p in expr.parts for x in _conjuncts(p)] if isinstance(expr, And) else [expr]


def fields(expr: Expr) -> set[str]:
    """The columns a tree reads."""
    if isinstance(expr, ColOp):
        return {expr.column}
    parts = expr.parts if isinstance(expr, (And, Or)) else (expr.part,) if isinstance(expr, Not) else ()
    return set().union(*map(fields, parts)) if parts else set()


def renamed(expr: Expr, names: Mapping[str, str]) -> Expr:
    """The tree over other column names."""
    if isinstance(expr, ColOp):
        return ColOp(names.get(expr.column, expr.column), expr.op, expr.value, expr.cast)
    if isinstance(expr, Not):
        return Not(renamed(expr.part, names))
    if isinstance(expr, (And, Or)):
        return type(expr)(tuple(renamed(p, names) for p in expr.parts))
    return expr


def period(field: str, start: Any, end: Any) -> dict[str, Any]:
    """Filters of a period: one day is an equality, more an inclusive range whose end is a bare date."""
    start, end = _date(start), _date(end)
    if start > end:
        raise FilterError("the period ends before it starts")
    return {f"{field}__date__exact": start} if start == end else {f"{field}__gte": start, f"{field}__lte": end}
