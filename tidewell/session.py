"""Sessions with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tidewell", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with ``SETTINGS`` and what ``conf`` adds, by full names."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in (SETTINGS | (conf or {})).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
