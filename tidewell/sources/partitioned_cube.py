"""Callable sources that executors read: partitions, Arrow batches and pushed filters, as a Python data source."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "tidewell_cube"
# Spark's filters as operators of the filter language.
PUSHED = {EqualTo: "exact", In: "in", GreaterThan: "gt", GreaterThanOrEqual: "gte", LessThan: "lt", LessThanOrEqual: "lte"}


@dataclass(frozen=True)
class PartitionedCube:
    """A source in parts, each read by a task.

    ``parts`` are values, or a function of the pushed filters that gives them
    (and may leave parts out that can hold no row). ``loader`` gets a part and
    the pushed filters, such as ``{"day__gte": ...}``, and gives Arrow batches
    or tables of the schema's columns. Filters on ``filterable`` columns are
    pushed, and the loader must apply them: Spark doesn't again. Both callables
    travel to the executors, so they hold no session. Nothing is read by the
    driver.
    """

    schema: Any
    parts: Sequence[Any] | Callable[[dict[str, Any]], Sequence[Any]]
    loader: Callable[[Any, dict[str, Any]], Iterator[pa.RecordBatch | pa.Table]]
    filterable: Sequence[str] = ()

    def read(self, spark: SparkSession) -> DataFrame:
        spark.dataSource.register(_CubeDataSource)
        # a session that has this off refuses readers that take filters
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        packed = base64.b64encode(cloudpickle.dumps((self.parts, self.loader, tuple(self.filterable)))).decode()
        return spark.read.format(NAME).schema(self.schema).option("cube", packed).load()


class _CubeDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def reader(self, schema) -> DataSourceReader:
        return _CubeReader(self.options["cube"], schema)


class _CubeReader(DataSourceReader):
    def __init__(self, packed: str, schema):
        self.parts, self.loader, self.filterable = cloudpickle.loads(base64.b64decode(packed))
        self.names, self.filters = schema.names, {}

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            op = PUSHED.get(type(f))
            column = ".".join(getattr(f, "attribute", ()))
            key = column if op == "exact" else f"{column}__{op}"
            if op and column in self.filterable and key not in self.filters:
                self.filters[key] = list(f.value) if op == "in" else f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        parts = self.parts(self.filters) if callable(self.parts) else self.parts
        return [InputPartition(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for found in self.loader(partition.value, self.filters):
            for batch in found.to_batches() if isinstance(found, pa.Table) else [found]:
                yield batch.select(self.names)
