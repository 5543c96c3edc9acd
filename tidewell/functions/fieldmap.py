"""Maps between storage names and semantic names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidewell.functions import filters as fl


@dataclass(frozen=True)
class FieldMap:
    """Storage name to semantic name, one to one."""

    names: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self):
        seen = list(self.names.values())
        if twice := sorted({n for n in seen if seen.count(n) > 1}):
            raise ValueError(f"semantic names that stand for several columns: {', '.join(twice)}")

    @property
    def storage(self) -> dict[str, str]:
        """Semantic name to storage name."""
        return {v: k for k, v in self.names.items()}

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({k: v for k, v in self.names.items() if k in df.columns})

    def columns(self, semantic: Sequence[str]) -> list[str]:
        return [self.storage.get(c, c) for c in semantic]

    def filters(self, expr: fl.Expr) -> fl.Expr:
        """A tree over semantic names, over storage names."""
        return fl.renamed(expr, self.storage)


def positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """All columns by new names, in order."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)
