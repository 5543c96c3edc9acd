"""Enrichment: attachments by key, and transformers of frames."""

from __future__ import annotations

import asyncio
import re
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions import types as ty
from tidewell.operators import joins, shape


class ExpressionError(ValueError):
    """An expression outside of the subset that is translated."""


def translate(expression: str) -> str:
    """A comparison or arithmetic expression as Spark SQL: ``==``, ``&``, ``|``, ``~``, ``and``, ``or``, ``not``, True, False, None."""
    pieces = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`)", expression)
    for k in range(0, len(pieces), 2):
        p = pieces[k]
        if "__" in p and re.search(r"\b__\w+__\b", p) or ";" in p or re.search(r"(?i)\b(select|from|exists)\b", p):
            raise ExpressionError(f"{expression!r}: not allowed")
        if re.search(r"[A-Za-z_]\w*\s*\.\s*[A-Za-z_]|@|\[", p):
            raise ExpressionError(f"{expression!r}: attributes, calls of objects and indexes have no Spark form")
        if "**" in p:
            raise ExpressionError(f"{expression!r}: use pow(a, b) for **")
    text = _logic(expression)
    text = re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", re.sub(r"\bNone\b", "null", text)))
    return re.sub(r'"((?:[^"\\]|\\.)*)"', lambda m: "'" + m[1].replace("'", "\\'") + "'", text)


def _logic(expression: str) -> str:
    """``&``, ``|`` and ``~`` between comparisons, outside of texts."""
    out, quote = [], ""
    for c in expression:
        if quote:
            out.append(c)
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
            out.append(c)
        else:
            out.append({"&": " AND ", "|": " OR ", "~": " NOT "}.get(c, c))
    return re.sub(r"(?<![<>=!])==(?!=)", "=", "".join(out))


# -------------------------------------------------------------- transformers
@runtime_checkable
class Transformer(Protocol):
    def transform(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class TypeCaster:
    """Declared types of columns that exist; what can't be cast is null, or an error if ``strict``."""

    casts: Mapping[str, str]
    strict: bool = False

    def transform(self, df: DataFrame) -> DataFrame:
        there = {c: t for c, t in self.casts.items() if c in df.columns}
        if self.strict:
            return df.withColumns({c: F.col(f"`{c}`").cast(ty.parse_type(t)) for c, t in there.items()})
        return ty.apply_schema_map(df, there)


@dataclass(frozen=True)
class RowFilter:
    """Rows for which all predicates hold."""

    predicates: Sequence[str]

    def transform(self, df: DataFrame) -> DataFrame:
        for p in self.predicates:
            df = df.where(F.expr(translate(p)))
        return df


@dataclass(frozen=True)
class DerivedColumn:
    """Columns by expression, in order; later ones see earlier ones."""

    columns: Mapping[str, str]

    def transform(self, df: DataFrame) -> DataFrame:
        for name, expression in self.columns.items():
            df = df.withColumn(name, F.expr(translate(expression)))
        return df


@dataclass(frozen=True)
class Deduplicator:
    subset: Sequence[str]
    keep: str | bool = "first"
    order_by: Sequence[str] | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        return shape.deduplicate(df, self.subset, self.keep, self.order_by)


@dataclass(frozen=True)
class Composite:
    steps: Sequence[Transformer]

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


# --------------------------------------------------------------- attachments
@dataclass(frozen=True)
class AttachmentSpec:
    """What to attach: ``attachment`` gets the distinct keys and gives a frame, or gives a DataFrame without asking for keys."""

    key: str
    attachment: Callable[..., Any]
    left_on: str
    right_on: str
    required: Sequence[str] = ()
    keyword: str | None = None
    drop: Sequence[str] = ()
    most: int | None = None


@dataclass(frozen=True)
class Enricher:
    """Attachments, in order. Those that need only columns of the frame itself are loaded together, ``at_once`` at a time."""

    specs: Sequence[AttachmentSpec]
    most: int = 5_000
    at_once: int = 4

    def transform(self, df: DataFrame) -> DataFrame:
        if self.at_once < 1:
            raise ValueError("one attachment at a time is the least")
        first = df
        with ThreadPoolExecutor(self.at_once) as pool:
            early = {k: pool.submit(self._loaded, first, spec) for k, spec in enumerate(self.specs) if not self._lacks(first, spec)}
            for k, spec in enumerate(self.specs):
                if gone := self._lacks(df, spec):
                    raise KeyError(f"{spec.key} needs {', '.join(gone)}")
                got = early[k].result() if k in early else self._loaded(df, spec)
                df = joins.string_key_join(df, got, spec.left_on, spec.right_on, spec.drop)
        return df

    @staticmethod
    def _lacks(df: DataFrame, spec: AttachmentSpec) -> list[str]:
        return [c for c in (*spec.required, spec.left_on) if c not in df.columns]

    def _loaded(self, df: DataFrame, spec: AttachmentSpec) -> DataFrame:
        if spec.keyword is None:
            got = spec.attachment()
        else:
            got = spec.attachment(**{spec.keyword: shape.distinct_values(df, spec.left_on, spec.most or self.most)})
        if asyncio.iscoroutine(got):
            got = asyncio.run(got)
        return df.sparkSession.createDataFrame(got) if isinstance(got, (pd.DataFrame, list)) else got
