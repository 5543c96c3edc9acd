"""Upserts into a table of a database: rows are staged over several connections, then merged in one transaction."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans import embedded, telemetry
from tidewell.plans.embedded import connection, driver
from tidewell.plans.sinks import SinkResult
from tidewell.sources import jdbc

#: How often rows are staged anew where a task that was run twice left rows twice.
ATTEMPTS = 3


def _like(url: str, stage: str, columns: str, table: str) -> str:
    """A statement that makes an empty table with the columns of another."""
    tail = "WITH NO DATA" if url.startswith(("jdbc:derby", "jdbc:postgresql")) else "WHERE 1 = 0"
    return f"CREATE TABLE {stage} AS SELECT {columns} FROM {table} {tail}"


def merge_statement(url: str, table: str, stage: str, keys: Sequence[str], others: Sequence[str]) -> str:
    """The database's statement that puts staged rows in place of those of their keys; names are quoted already."""
    columns = ", ".join([*keys, *others])
    if url.startswith("jdbc:mysql"):
        changes = ", ".join(f"{c} = VALUES({c})" for c in others or keys)
        return f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} ON DUPLICATE KEY UPDATE {changes}"
    if url.startswith(("jdbc:postgresql", "jdbc:sqlite", "jdbc:duckdb")):
        changes = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in others) if others else "NOTHING"
        return f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {stage} WHERE 1 = 1 ON CONFLICT ({', '.join(keys)}) DO {changes}"
    if url.startswith("jdbc:derby"):
        same = " AND ".join(f"t.{k} = s.{k}" for k in keys)
        update = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in others)} " if others else ""
        return f"MERGE INTO {table} t USING {stage} s ON {same} {update}WHEN NOT MATCHED THEN INSERT ({columns}) VALUES ({', '.join(f's.{c}' for c in [*keys, *others])})"
    raise ValueError(f"no upserts into {url.split(':')[1]}")


@dataclass(frozen=True)
class JdbcUpsertSink:
    """Rows replace those of their keys in a table that exists; of the columns, those count that the table has.

    Tasks write to a table beside the target, each over a connection of its own,
    and the driver has the database merge it in one transaction: whatever fails
    before leaves the target as it was. A task that is run again after it had
    committed leaves its rows twice; the staged rows are counted against those
    that were computed, and staged anew if there are more. A null key matches
    nothing, so its row is new. Several rows of one key are an error. A database
    that is in the driver's process takes in files that tasks write. No other
    database than Derby was run.
    """

    spark: SparkSession
    url: str
    table: str
    keys: Sequence[str]
    options: Mapping[str, str] = field(default_factory=dict, repr=False)
    workers: int = 8

    def write(self, df: DataFrame, *, overwrite: bool = False) -> SinkResult:
        if overwrite:
            raise ValueError("an upsert overwrites no table")
        target = jdbc.JdbcSource(self.url, table=self.table, options=self.options).read(self.spark).schema.names
        named = {c.lower(): c for c in target}
        if not self.keys or any(k.lower() not in named or k not in df.columns for k in self.keys):
            raise KeyError(f"keys of an upsert are columns of the rows and of {self.table}")
        df = df.select(*(F.col(f"`{c}`").alias(named[c.lower()]) for c in df.columns if c.lower() in named))
        keys = [named[k.lower()] for k in self.keys]
        quoted = {c: self._quoted(c) for c in df.columns}
        df = df.persist(StorageLevel.MEMORY_AND_DISK)  # counted and written, computed once
        try:
            return self._merged(df, keys, quoted)
        finally:
            df.unpersist()

    def _merged(self, df: DataFrame, keys: list[str], quoted: Mapping[str, str]) -> SinkResult:
        with telemetry.span("sink", kind="jdbc"):
            n = df.count()
            for _ in range(ATTEMPTS):
                stage = f"{self.table}_staged_{uuid.uuid4().hex[:12]}"
                try:
                    self._run(_like(self.url, stage, ", ".join(quoted.values()), self.table))
                    self._stage(df, stage)
                    if self._one(f"SELECT COUNT(*) FROM {stage}") != n:
                        continue
                    of_keys = ", ".join(quoted[k] for k in keys)
                    if self._one(f"SELECT COUNT(*) FROM (SELECT 1 AS one FROM {stage} WHERE {' AND '.join(f'{quoted[k]} IS NOT NULL' for k in keys)} GROUP BY {of_keys} HAVING COUNT(*) > 1) d"):
                        raise ValueError("several rows of one key")
                    self._run(merge_statement(self.url, self.table, stage, [quoted[k] for k in keys], [q for c, q in quoted.items() if c not in keys]))
                    return SinkResult(f"{self.url.split(';')[0]}/{self.table}", ())
                finally:
                    self._run(f"DROP TABLE {stage}", quiet=True)
        raise OSError(f"rows were staged twice {ATTEMPTS} times")

    def _stage(self, df: DataFrame, stage: str) -> None:
        if embedded.is_embedded(self.url):
            embedded.load(df, self.url, stage, self.options)
            return
        options = {"url": self.url, "dbtable": stage, "driver": driver(self.url, self.options), "numPartitions": str(self.workers)} | dict(self.options)
        df.write.format("jdbc").options(**options).mode("append").save()

    def _quoted(self, name: str) -> str:
        return self.spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def _connection(self):
        return connection(self.spark, self.url, self.options)

    def _run(self, sql: str, *, quiet: bool = False) -> None:
        """One statement in a transaction of its own."""
        with self._connection() as connection:
            connection.setAutoCommit(False)
            try:
                connection.createStatement().executeUpdate(sql)
                connection.commit()
            except Exception:
                connection.rollback()
                if not quiet:
                    raise

    def _one(self, sql: str) -> int:
        with self._connection() as connection:
            found = connection.createStatement().executeQuery(sql)
            found.next()
            return found.getLong(1)


@dataclass(frozen=True)
class JdbcStore:
    """Marks as rows (source, value, updated_at) of a table of a database, which is made if it isn't there."""

    spark: SparkSession
    url: str
    table: str = "tidewell_marks"
    options: Mapping[str, str] = field(default_factory=dict, repr=False)

    def _prepared(self, made: Any, sql: str, *values: Any) -> Any:
        statement = made.prepareStatement(sql)
        for k, v in enumerate(values):
            statement.setString(k + 1, v)
        return statement

    def _there(self, made: Any) -> bool:
        for name in (self.table, self.table.upper(), self.table.lower()):
            if made.getMetaData().getTables(None, None, name, None).next():
                return True
        return False

    def read(self, source: str) -> Any:
        with connection(self.spark, self.url, self.options) as made:
            if not self._there(made):
                return None
            found = self._prepared(made, f"SELECT mark FROM {self.table} WHERE source = ?", source).executeQuery()
            return json.loads(found.getString(1)) if found.next() else None

    def write(self, source: str, value: Any) -> None:
        """Put the mark in its row, in one transaction."""
        text = json.dumps(value, default=str)
        with connection(self.spark, self.url, self.options) as made:
            if not self._there(made):
                made.createStatement().executeUpdate(f"CREATE TABLE {self.table} (source VARCHAR(255) NOT NULL PRIMARY KEY, mark VARCHAR(4000), updated_at TIMESTAMP)")
            made.setAutoCommit(False)
            try:
                if not self._prepared(made, f"UPDATE {self.table} SET mark = ?, updated_at = CURRENT_TIMESTAMP WHERE source = ?", text, source).executeUpdate():
                    self._prepared(made, f"INSERT INTO {self.table} (source, mark, updated_at) VALUES (?, ?, CURRENT_TIMESTAMP)", source, text).executeUpdate()
                made.commit()
            except Exception:
                made.rollback()
                raise
