"""Spans and counters of loads and writes, by an exchangeable provider."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections import defaultdict
from typing import Any, Protocol

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class Provider(Protocol):
    def record(self, name: str, seconds: float, tags: dict[str, Any]) -> None: ...

    def count(self, name: str, n: float, tags: dict[str, Any]) -> None: ...


class Noop:
    def record(self, name, seconds, tags) -> None:
        pass

    def count(self, name, n, tags) -> None:
        pass


class InMemory:
    def __init__(self):
        self.spans: list[tuple[str, float, dict]] = []
        self.counts: dict[str, float] = defaultdict(float)

    def record(self, name, seconds, tags) -> None:
        self.spans.append((name, seconds, tags))

    def count(self, name, n, tags) -> None:
        self.counts[name] += n


_provider: Provider = Noop()


def use(provider: Provider) -> Provider:
    """Make ``provider`` the one in use; returns the one before."""
    global _provider
    before, _provider = _provider, provider
    return before


@contextlib.contextmanager
def span(name: str, **tags: Any):
    began = time.perf_counter()
    try:
        yield
    finally:
        _provider.record(name, time.perf_counter() - began, tags)


def count(name: str, n: float = 1, **tags: Any) -> None:
    _provider.count(name, n, tags)


#: What Spark tells of a stage, by the name that it is counted under.
STAGE = {
    "tasks": "numCompleteTasks",
    "rows_read": "inputRecords",
    "bytes_read": "inputBytes",
    "rows_written": "outputRecords",
    "bytes_written": "outputBytes",
    "shuffle_bytes": "shuffleWriteBytes",
    "spilled_bytes": "diskBytesSpilled",
    "cpu_nanoseconds": "executorCpuTime",
}


@contextlib.contextmanager
def measured(spark: SparkSession, name: str, **tags: Any):
    """A span whose jobs' work is counted, ``name.rows_read`` and so on, by what Spark itself measured of their stages.

    Jobs of this thread that run within, and no others, count; a lazy frame's
    work counts where it is collected or written.
    """
    sc, group = spark.sparkContext, f"tidewell-{uuid.uuid4().hex}"
    before = sc.getLocalProperty("spark.jobGroup.id"), sc.getLocalProperty("spark.job.description")
    sc.setJobGroup(group, name)
    try:
        with span(name, **tags):
            yield
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before[0])
        sc.setLocalProperty("spark.job.description", before[1])
        jvm = sc._jsc.sc()
        jvm.listenerBus().waitUntilEmpty()
        tracker, store, totals = sc.statusTracker(), jvm.statusStore(), dict.fromkeys(STAGE, 0)
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in (tracker.getJobInfo(job).stageIds if tracker.getJobInfo(job) else ())}
        for stage in stages:
            if tracker.getStageInfo(stage) is None:
                continue  # it never ran, or was forgotten
            told = store.lastStageAttempt(stage)
            for key, getter in STAGE.items():
                totals[key] += getattr(told, getter)()
        for key, n in totals.items():
            count(f"{name}.{key}", n, **tags)


class StreamListener(StreamingQueryListener):
    """Feeds the provider what every micro-batch of the session's streams did; add it by ``spark.streams.addListener``."""

    def onQueryStarted(self, event) -> None:
        count("stream.started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        tags = {"stream": p.name or str(p.id), "batch": p.batchId}
        count("stream.batches", 1, **tags)
        count("stream.rows", p.numInputRows, **tags)
        for s in p.stateOperators:
            count("stream.late_rows", s.numRowsDroppedByWatermark, **tags)
        _provider.record("stream.batch", (p.durationMs.get("triggerExecution") or 0) / 1000, tags)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        count("stream.failed" if event.exception else "stream.ended")
