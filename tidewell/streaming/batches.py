"""Streams into sinks, a micro-batch at a time, and event time: sessions, and duplicates within a time."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import shape
from tidewell.plans.sinks import ParquetSink, UpsertSink
from tidewell.sources import files, hadoop

#: The record of a dataset's streams; readers of Parquet pass over names like this.
BATCHES = "_batches.json"


@dataclass
class BatchSink:
    """Writes each micro-batch of a stream once, however often Spark hands it over.

    The numbers of written batches are kept beside the dataset, by ``stream``.
    An upsert that is done again changes nothing, so its number is written after
    it. Appended files carry stream and batch in their names: a batch whose
    number isn't recorded has what it left before removed, and then its files
    are moved in. Only the first batch after a start can have left something.

    Rows of one key in a batch are an error for an upsert, unless ``order``
    (columns) tells which is the last.
    """

    sink: ParquetSink | UpsertSink
    stream: str
    order: Sequence[str] = ()
    _clean: bool = field(default=False, repr=False)

    def __post_init__(self):
        if not isinstance(self.sink, (ParquetSink, UpsertSink)):
            raise TypeError("a stream goes to a Parquet or an upsert sink")
        if not self.stream or not self.stream.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a stream's name has letters, digits, hyphens and underscores")

    @property
    def _path(self) -> str:
        return self.sink.path.rstrip("/")

    def written(self) -> dict[str, int]:
        """The last batch of each stream that the dataset has."""
        return json.loads(hadoop.read_text(self.sink.spark, f"{self._path}/{BATCHES}") or "{}")

    def __call__(self, df: DataFrame, batch: int) -> None:
        done = self.written()
        if batch <= done.get(self.stream, -1):
            return
        if isinstance(self.sink, UpsertSink):
            self.sink.write(shape.deduplicate(df, list(self.sink.keys), "last", list(self.order)) if self.order else df)
        else:
            self._append(df, batch)
        # a whole upsert swaps the folder, so the record is written anew
        hadoop.write_text(self.sink.spark, f"{self._path}/{BATCHES}", json.dumps(done | {self.stream: batch}))
        self._clean = True

    def _append(self, df: DataFrame, batch: int) -> None:
        spark, path, name = self.sink.spark, self._path, f"{self.stream}-{batch:012d}-"
        if not self._clean:
            for f in hadoop.listed(spark, path, ".parquet"):
                if f.rsplit("/", 1)[-1].startswith(name):
                    hadoop.delete(spark, f)
        old = self.sink._check_append(df, path)
        staged = f"{path}.{name}staged"
        hadoop.delete(spark, staged)
        ParquetSink(spark, staged, self.sink.partition_on, date_field=self.sink.date_field).write(df)
        made = hadoop.listed(spark, staged, ".parquet")
        for k, (f, own) in enumerate(zip(made, hadoop.below(spark, staged, made), strict=True)):
            folder = own.rpartition("/")[0]
            hadoop.moved(spark, f, f"{path}/{folder + '/' if folder else ''}{name}{k:05d}.parquet")
        self.sink._noted(files.read_dataset(spark, staged), path, old)
        hadoop.delete(spark, staged)


def stream_into(stream: DataFrame, sink: BatchSink, checkpoint: str) -> int:
    """Everything that a stream has now, into a sink; returns how many rows came."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def once(stream: DataFrame, at: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """A stream without repeats of its keys that come within ``late`` of each other in event time; state older than that goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def sessions(df: DataFrame, at: str, keys: Sequence[str], gap: str = "30 minutes", late: str | None = None, aggregates: dict[str, Callable[[], object]] | None = None) -> DataFrame:
    """Sessions of each key: rows no further apart than ``gap``, with their start, last moment and number of rows.

    Of a stream, sessions come when the watermark has passed their end, and rows
    later than ``late`` are dropped (None: the stream has a watermark already);
    of a table, all come. ``at`` is an instant.
    """
    if df.isStreaming and late is not None:
        df = df.withWatermark(at, late)
    more = [make().alias(name) for name, make in (aggregates or {}).items()]
    out = df.groupBy(F.session_window(F.col(at), gap).alias("_session"), *keys).agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"), *more)
    return out.select(*keys, F.col("_session.start").alias("start"), "last", "n", *(aggregates or {}))
