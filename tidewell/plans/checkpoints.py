"""Resumable loads: slices of a plan, each written once."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidewell.sources import hadoop


@dataclass(frozen=True)
class Slice:
    """A condition that selects part of a source, with its parameters."""

    predicate: str
    params: tuple[tuple[str, Any], ...] = ()

    @property
    def key(self) -> str:
        return hashlib.sha256(json.dumps([self.predicate, self.params], default=str).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class SlicePlan:
    slices: tuple[Slice, ...]

    @classmethod
    def of(cls, predicates: Sequence[str]) -> SlicePlan:
        return cls(tuple(Slice(p) for p in predicates))

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> SlicePlan:
        return cls(tuple(Slice(s["predicate"], tuple(tuple(p) for p in s["params"])) for s in json.loads(text)["slices"]))


def run(spark: SparkSession, plan: SlicePlan, read: Callable[[Slice], DataFrame], path: str) -> DataFrame:
    """The union of all slices. A slice whose folder has its success mark isn't read again."""
    for s in plan.slices:
        folder = f"{path}/{s.key}"
        if not hadoop.exists(spark, f"{folder}/_SUCCESS"):
            read(s).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*(f"{path}/{s.key}" for s in plan.slices))


def finished(spark: SparkSession, plan: SlicePlan, path: str) -> list[str]:
    return [s.key for s in plan.slices if hadoop.exists(spark, f"{path}/{s.key}/_SUCCESS")]


def forget(spark: SparkSession, path: str) -> None:
    hadoop.delete(spark, path)
