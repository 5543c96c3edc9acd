"""Callable sources: cubes with hooks, dated artifacts and datasets of a past and a live part."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import filters as fl
from tidewell.functions import types as ty


class CubeContractError(TypeError):
    """A loader or hook gave what isn't a DataFrame, or a request isn't valid."""


@dataclass(frozen=True)
class CubeSource:
    """A loader of frames. Hooks run in this order: the request's transformer and
    validator, the loader, the check that it gave a frame, the frame's transformer."""

    loader: Callable[[SparkSession, Mapping[str, Any]], DataFrame]
    request_transformer: Callable[[dict], dict] | None = None
    request_validator: Callable[[Mapping[str, Any]], None] | None = None
    frame_transformer: Callable[[DataFrame], DataFrame] | None = None
    defaults: Mapping[str, Any] = field(default_factory=dict)

    def read(self, spark: SparkSession, **request: Any) -> DataFrame:
        asked = dict(self.defaults) | request
        if self.request_transformer:
            asked = self.request_transformer(asked)
        if self.request_validator:
            self.request_validator(asked)
        df = self.loader(spark, asked)
        if not isinstance(df, DataFrame):
            raise CubeContractError(f"the loader gave {type(df).__name__}")
        if self.frame_transformer:
            df = self.frame_transformer(df)
            if not isinstance(df, DataFrame):
                raise CubeContractError(f"the frame transformer gave {type(df).__name__}")
        return df


class BaseCube:
    """Load, then ``fix_data`` where a class has it and there are rows."""

    source: CubeSource

    def fix_data(self, df: DataFrame) -> DataFrame:
        return df

    def load(self, spark: SparkSession, **request: Any) -> DataFrame:
        df = self.source.read(spark, **request)
        if type(self).fix_data is BaseCube.fix_data or df.isEmpty():
            return df
        return self.fix_data(df)


def day(value: Any) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    return value if isinstance(value, dt.date) else dt.datetime.strptime(str(value)[:10], "%Y-%m-%d").date()


@dataclass
class BaseArtifact:
    """A load over a window of days, with hooks before and after."""

    start: Any
    end: Any

    def __post_init__(self):
        self.start, self.end = day(self.start), day(self.end)
        if self.start > self.end:
            raise ValueError("the window ends before it starts")

    def to_params(self) -> dict[str, str]:
        return {"start_date": self.start.isoformat(), "end_date": self.end.isoformat()}

    def before_load(self, params: dict[str, Any]) -> dict[str, Any]:
        return params

    def load_frame(self, spark: SparkSession, params: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def after_load(self, df: DataFrame) -> DataFrame:
        return df

    def load(self, spark: SparkSession, **params: Any) -> DataFrame:
        return self.after_load(self.load_frame(spark, self.before_load(self.to_params() | params)))


@dataclass(frozen=True)
class HybridDataset:
    """Days before ``split`` come from one source, the others from another.

    A window on both sides is one plan of two filtered branches; each branch's
    filter reaches its own scan.
    """

    historical: Callable[[SparkSession], DataFrame]
    live: Callable[[SparkSession], DataFrame]
    date_field: str
    split: Any

    def load(self, spark: SparkSession, start: Any, end: Any, source: str = "auto", **filters: Any) -> DataFrame:
        start, end, split = day(start), day(end), day(self.split)
        if start > end:
            raise ValueError("the window ends before it starts")
        if source not in ("auto", "historical", "live"):
            raise ValueError("source is auto, historical or live")
        if source == "auto":
            source = "historical" if end < split else "live" if start >= split else "both"
        parts = []
        if source in ("historical", "both"):
            parts.append(self._part(self.historical(spark), start, min(end, split - dt.timedelta(days=1)) if source == "both" else end, filters))
        if source in ("live", "both"):
            parts.append(self._part(self.live(spark), max(start, split) if source == "both" else start, end, filters))
        return parts[0] if len(parts) == 1 else ty.union_widened(*parts)

    def _part(self, df: DataFrame, start: dt.date, end: dt.date, filters: Mapping[str, Any]) -> DataFrame:
        return fl.apply(df, {f"{self.date_field}__date__gte": start, f"{self.date_field}__date__lte": end} | dict(filters))


def with_default(source: CubeSource, **defaults: Any) -> CubeSource:
    return replace(source, defaults=dict(source.defaults) | defaults)


def between_days(df: DataFrame, column: str, start: Any, end: Any) -> DataFrame:
    """Rows of whole days, ends included."""
    return df.where(F.to_date(f"`{column}`").between(F.lit(day(start)), F.lit(day(end))))
