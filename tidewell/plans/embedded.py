"""Derby databases that a process holds itself: filled from files of tasks, and published so that every executor reads them.

A database that is no server is in one process alone: on a cluster a task
that opens the driver's database by its URL gets another, empty one. So tasks
write their rows as files to the folder that all share, and the database in
the driver's process takes those files in by its own import, a file at a time;
no row goes through Python or Spark's driver. To be read by tasks, a database
is shut down and packed into one file of that folder, which any number of
processes may open, each for itself and to read only.
"""

from __future__ import annotations

import math
import os
import re
import shutil
import tempfile
import zipfile
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import hadoop, jdbc

#: Rows of a table that is filled in parts, and the most parts.
PART, MOST_PARTS = 500_000, 16
#: Bytes of a page of a table that is filled in parts, and of what is copied at once.
PAGE, BUFFER = 32_768, 1 << 20


def is_embedded(url: str) -> bool:
    """Whether a database is in the process that opens it, and not a server's."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def driver(url: str, options: Mapping[str, str]) -> str:
    return options.get("driver") or next(d for p, d in jdbc.DRIVERS.items() if url.startswith(p))


@contextmanager
def connection(spark: SparkSession, url: str, options: Mapping[str, str]):
    """A connection of the driver's own."""
    jvm = spark.sparkContext._jvm
    jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(driver(url, options))
    properties = jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, str(v))
    made = jvm.java.sql.DriverManager.getConnection(url, properties)
    try:
        yield made
    finally:
        made.close()


# ------------------------------------------------------------------- filling
def _field(spark: SparkSession, name: str, kind: T.DataType) -> Column:
    """A value as the import takes it: texts in quotes, bytes as hexadecimal digits, nulls as nothing."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        c = F.hex(c)
    elif isinstance(kind, T.TimestampType):  # a moment is stored as the wall clock of the process, as by Spark's writer
        zones = spark.conf.get("spark.sql.session.timeZone"), spark.sparkContext._jvm.java.util.TimeZone.getDefault().getID()
        c = F.convert_timezone(*map(F.lit, zones), c.cast("timestamp_ntz")).cast("string")
    elif isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        c = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit(""))


def _place(table: str) -> tuple[str | None, str]:
    """Schema and name of a table as the catalogue has them."""
    parts = [p[1:-1].replace('""', '"') if p.startswith('"') else p.upper() for p in re.findall(r'"(?:[^"]|"")+"|[^.]+', table)]
    return (parts[-2] if len(parts) > 1 else None), parts[-1]


def _write(df: DataFrame, folder: str) -> None:
    """Rows as text files that the import takes, one a partition."""
    # a line of nothing would be no row: a mark at each line's end is a column that isn't imported
    fields = [_field(df.sparkSession, f.name, f.dataType) for f in df.schema]
    df.select(F.concat_ws(",", *fields, F.lit("1"))).write.option("maxRecordsPerFile", 0).text(folder)


def _take_in(made: Any, table: str, width: int, path: str) -> None:
    """Append a file's rows, of so many columns, to a table."""
    schema, name = _place(table)
    call = made.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_DATA(?, ?, NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
    for k, v in enumerate((schema, name, ",".join(str(k + 1) for k in range(width)), path)):
        call.setString(k + 1, v)
    call.execute()


def load(df: DataFrame, url: str, table: str, options: Mapping[str, str] | None = None) -> None:
    """Append rows to a table with the frame's columns in the frame's order."""
    spark = df.sparkSession
    folder = hadoop.scratch(spark, "import")
    try:
        _write(df, folder)
        with connection(spark, url, options or {}) as made:
            for file in hadoop.data_files(spark, folder):
                with hadoop.local_file(spark, file) as path:
                    _take_in(made, table, len(df.columns), path)
    finally:
        hadoop.delete(spark, folder)


# ---------------------------------------------------------------- publishing
class Database:
    """A database in a folder of the driver's machine."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, tempfile.mkdtemp(prefix="tidewell-derby-")
        self.url = f"jdbc:derby:{self.folder}/db;create=true"

    def run(self, sql: str) -> None:
        with connection(self.spark, self.url, {}) as made:
            made.createStatement().executeUpdate(sql)

    def load(self, df: DataFrame, table: str) -> None:
        load(df, self.url, table)

    def load_parts(self, df: DataFrame, table: str, columns: str, index: str, parts: int) -> list[str]:
        """The frame's partitions, one after another, as up to so many tables with an index each, whose names are the table's and a number.

        Importing and indexing a table is one thread's work, so tables are
        filled side by side, as many as the driver's process has processors.
        Only a table's first file is taken in without a log.
        """
        folder = hadoop.scratch(self.spark, "import")
        # a statement that reads the catalogue waits as long as another's import holds it
        self.run("CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.locks.waitTimeout', '-1')")
        # a published page is sought in its file anew each time, so there are fewer of them
        self.run(f"CALL SYSCS_UTIL.SYSCS_SET_DATABASE_PROPERTY('derby.storage.pageSize', '{PAGE}')")

        def fill(part: str, files: list[str]) -> str:
            with connection(self.spark, self.url, {}) as made:
                made.createStatement().executeUpdate(f"CREATE TABLE {part} ({columns})")
                for file in files:
                    with hadoop.local_file(self.spark, file) as path:
                        _take_in(made, part, len(df.columns), path)
                made.createStatement().executeUpdate(f'CREATE INDEX {part}_index ON {part} ("{index}")')
            return part

        try:
            _write(df, folder)
            files = hadoop.data_files(self.spark, folder)
            n = max(1, min(parts, len(files)))
            of_each = [files[len(files) * k // n : len(files) * (k + 1) // n] for k in range(n)]
            with ThreadPoolExecutor(self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime().availableProcessors()) as pool:
                return list(pool.map(fill, [f"{table}_{k}" for k in range(n)], of_each))
        finally:
            hadoop.delete(self.spark, folder)

    def close(self) -> None:
        """Shut it down, so that its files are whole."""
        try:
            with connection(self.spark, self.url.split(";")[0] + ";shutdown=true", {}):
                pass
        except Py4JJavaError as error:
            if error.java_exception.getSQLState() != "08006":  # what a shutdown that went well says
                raise

    def published(self) -> str:
        """The URL by which all processes read it from now on; it can't be changed any more."""
        self.close()
        path = hadoop.mounted(self.spark, hadoop.scratch(self.spark, "database") + ".jar")
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as out:  # not packed tightly: pages are read from anywhere
            for folder, _, names in os.walk(f"{self.folder}/db"):
                for name in names:
                    if not name.endswith(".lck"):
                        with open(f"{folder}/{name}", "rb") as file, out.open(zipfile.ZipInfo.from_file(file.name, os.path.relpath(file.name, self.folder)), "w") as packed:
                            shutil.copyfileobj(file, packed, BUFFER)
        shutil.rmtree(self.folder)
        return f"jdbc:derby:jar:({path})db"


def source(spark: SparkSession, rows: DataFrame, name: str, columns: str, index: str, **more: Any) -> jdbc.JdbcSource:
    """Rows as a table, with an index, of a database that every executor reads; ``columns`` are those of the rows."""
    database = Database(spark)
    database.run(f"CREATE TABLE {name} ({columns})")
    database.load(rows, name)
    database.run(f'CREATE INDEX {name}_index ON {name} ("{index}")')
    return jdbc.JdbcSource(database.published(), **({"table": name} | more))


@dataclass(frozen=True)
class Parts:
    """A table that a database has as several, each with a range of a text key's values."""

    parts: tuple[jdbc.JdbcSource, ...]

    def read(self, spark: SparkSession) -> DataFrame:
        return jdbc.text_ranges(spark, self.parts)


def parted(spark: SparkSession, rows: DataFrame, name: str, columns: str, index: str, **more: Any) -> Parts:
    """Rows as ``source`` has them, but in a table for each ``PART`` of them, ``MOST_PARTS`` at most; the index is of a text key that ranges are cut by."""
    parts = min(MOST_PARTS, max(1, math.ceil(rows.count() / PART)))
    by = F.col(f"`{index}`")
    dealt = rows.repartitionByRange(parts, by).sortWithinPartitions(by) if parts > 1 else rows
    database = Database(spark)
    tables = database.load_parts(dealt, name, columns, index, parts)
    url = database.published()
    return Parts(tuple(jdbc.JdbcSource(url, table=t, partition_column=index, **more) for t in tables))
