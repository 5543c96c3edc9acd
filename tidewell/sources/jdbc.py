"""SQL databases by JDBC: partition plans, checks and bounds."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import guard, hadoop

#: The default chunk and the bounds of connections at a time.
CHUNK, LEAST_WORKERS, MOST_WORKERS = 50_000, 1, 16
#: Rows of a statement's result that come over at once where an option doesn't say.
FETCH = 10_000
# Drivers by URL prefix.
DRIVERS = {
    "jdbc:postgresql": "org.postgresql.Driver",
    "jdbc:mysql": "com.mysql.cj.jdbc.Driver",
    "jdbc:clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
    "jdbc:duckdb": "org.duckdb.DuckDBDriver",
    "jdbc:sqlite": "org.sqlite.JDBC",
    "jdbc:derby": "org.apache.derby.iapi.jdbc.AutoloadedDriver",
}


@dataclass(frozen=True)
class JdbcSource:
    """A table or reading statement of a database."""

    url: str
    table: str | None = None
    query: str | None = None
    options: Mapping[str, str] = field(default_factory=dict, repr=False)
    partition_column: str | None = None
    chunk: int = CHUNK
    workers: int = 8
    limit: int | None = None

    def __post_init__(self):
        if (self.table is None) == (self.query is None):
            raise ValueError("a table or a query is needed")
        if self.query is not None:
            text = guard.check(self.query)
            if self.partition_column and re.search(r"(?i)\b(limit|offset|order\s+by)\b", text):
                raise ValueError("a partitioned statement has no LIMIT, OFFSET or ORDER BY")
        if self.partition_column and self.limit is not None:
            raise ValueError("a range plan takes no limit")
        if not LEAST_WORKERS <= self.workers <= MOST_WORKERS:
            raise ValueError(f"workers are {LEAST_WORKERS} to {MOST_WORKERS}")
        if self.chunk < 1:
            raise ValueError("a chunk has a row at least")

    def _reader(self, spark: SparkSession, table: str):
        driver = next((d for p, d in DRIVERS.items() if self.url.startswith(p)), None)
        reader = spark.read.format("jdbc").option("url", self.url).option("dbtable", table).options(**self.options)
        return reader.option("driver", driver) if driver and "driver" not in self.options else reader

    @property
    def relation(self) -> str:
        return self.table if self.table is not None else f"({guard.check(self.query)}) q"

    def read(self, spark: SparkSession) -> DataFrame:
        whole = self._reader(spark, self.relation).load()
        if self.partition_column is None:
            return whole if self.limit is None else whole.limit(self.limit)
        if isinstance(whole.schema[self._column(whole)].dataType, T.StringType):
            return text_ranges(spark, [self], whole)
        plan = self.plan(spark)
        if plan.partitions == 1:
            return whole
        reader = self._reader(spark, self.relation).option("partitionColumn", self.partition_column)
        df = reader.option("lowerBound", str(plan.lower)).option("upperBound", str(plan.upper)).option("numPartitions", plan.partitions).load()
        # a task has one connection at a time: so many tasks, so many connections
        return df.coalesce(self.workers) if plan.partitions > self.workers else df

    def _column(self, whole: DataFrame) -> str:
        """The partition column as the database writes it."""
        return next((c for c in whole.columns if c.lower() == self.partition_column.lower()), self.partition_column)

    def _properties(self) -> dict[str, str]:
        driver = self.options.get("driver") or next((d for p, d in DRIVERS.items() if self.url.startswith(p)), None)
        return {k: str(v) for k, v in self.options.items()} | ({"driver": driver} if driver else {})

    def _marks(self, spark: SparkSession, name: str) -> DataFrame:
        """Every chunk-th key of a column as ``k`` with its place ``n`` among the keys, from 0, as the database sorts them."""
        q = self._quoted(spark, name)
        own = {k: v for k, v in self._properties().items() if k.lower() != "pushdownpredicate"} | {"pushDownPredicate": "false"}
        if "fetchsize" not in map(str.lower, own):
            own["fetchsize"] = str(FETCH)
        # the order is the statement's own and no sub-select's, so it is that of the rows; nothing may be added to the condition
        keys = spark.read.jdbc(self.url, self.relation, predicates=[f"{q} IS NOT NULL ORDER BY {q}"], properties=own)
        # one statement is one partition, whose ids are its rows' places
        return keys.select(F.col(f"`{name}`").alias("k"), F.monotonically_increasing_id().alias("n")).where(F.col("n") % self.chunk == 0)

    def cuts(self, spark: SparkSession, whole: DataFrame | None = None) -> list[str]:
        """Keys at which ranges of a chunk begin, in the database's own order.

        One statement reads all keys in that order, and every chunk-th is a cut:
        the work grows with the keys, not with the ranges, and best has an index.
        A key is in one range, whatever its rows. The driver has a key a range.
        """
        whole = self._reader(spark, self.relation).load() if whole is None else whole
        return _cuts(self._marks(spark, self._column(whole)).collect())

    def _quoted(self, spark: SparkSession, name: str) -> str:
        return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def plan(self, spark: SparkSession) -> RangePlan:
        """Bounds and partitions: one fetch for a table of up to a chunk."""
        c = self.partition_column
        dialect = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url)
        q = dialect.quoteIdentifier(c)
        n, low, high = self._reader(spark, f"(select count(*) as n, min({q}) as lo, max({q}) as hi from {self.relation}) b").load().first()
        return RangePlan(c, low, high, max(1, math.ceil(n / self.chunk)) if low is not None else 1)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _cuts(marks: Iterable[Row]) -> list[str]:
    """Keys of marks in the order of their places, each once; the least key begins no range, as the first has no beginning."""
    found = [r.k for r in sorted(marks, key=lambda r: r.n)]
    return [k for k in dict.fromkeys(found) if k != found[0]]


def text_ranges(spark: SparkSession, sources: Sequence[JdbcSource], whole: DataFrame | None = None) -> DataFrame:
    """Rows of sources of like columns by ranges of a text key with a chunk of rows each; null keys belong to a source's first.

    The ranges of all are found by one job, and read by as many tasks, each
    over a connection at a time, as the first source has workers.
    """
    first = sources[0]
    name = first._column(first._reader(spark, first.relation).load() if whole is None else whole)
    marks = reduce(DataFrame.union, (s._marks(spark, name).select("k", "n", F.lit(k).alias("source")) for k, s in enumerate(sources)))
    found: dict[int, list[Row]] = {k: [] for k in range(len(sources))}
    for r in (marks.coalesce(first.workers) if len(sources) > first.workers else marks).collect():
        found[r.source].append(r)
    predicates = [text_predicates(s._quoted(spark, name), _cuts(found[k])) for k, s in enumerate(sources)]
    df = reduce(DataFrame.union, (spark.read.jdbc(s.url, s.relation, predicates=p, properties=s._properties()) for s, p in zip(sources, predicates, strict=True)))
    return df.coalesce(first.workers) if sum(map(len, predicates)) > first.workers else df


def text_predicates(column: str, cuts: list[str]) -> list[str]:
    """Half-open ranges of a text column as conditions, whose union is every row once."""
    if not cuts:
        return ["1 = 1"]
    marks = list(map(_text, cuts))
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(marks, marks[1:], strict=False)]
    return [f"{column} < {marks[0]} OR {column} IS NULL", *middle, f"{column} >= {marks[-1]}"]


@dataclass(frozen=True)
class RangePlan:
    """Half-open ranges of a column; null keys belong to the first."""

    column: str
    lower: Any
    upper: Any
    partitions: int

    def predicates(self) -> list[str]:
        """The ranges as conditions, whose union is every row once."""
        if self.partitions <= 1 or self.lower is None:
            return ["1 = 1"]
        step = (self.upper - self.lower + 1) / self.partitions
        cuts = sorted({self.lower + math.ceil(step * k) for k in range(1, self.partitions)} - {self.lower})
        if not cuts:
            return ["1 = 1"]
        c = self.column
        middle = [f"{c} >= {a} AND {c} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
        return [f"{c} < {cuts[0]} OR {c} IS NULL", *middle, f"{c} >= {cuts[-1]}"]

    def to_json(self) -> str:
        return json.dumps(asdict(self), default=str)

    @classmethod
    def from_json(cls, text: str) -> RangePlan:
        return cls(**json.loads(text))


def paged(df: DataFrame, key: str, size: int = CHUNK, *, page: str = "page") -> DataFrame:
    """All rows with the number, from 0, of the page of up to ``size`` rows that each is on in the order of a unique key; null comes last.

    Rows are dealt by ranges of the key, and each range is sorted and written
    once with the rows' places in it, which the rows of the ranges before are
    added to: the work grows with the rows, not with the pages, and the driver
    has a count a range.
    """
    if size < 1:
        raise ValueError("a page has a row at least")
    if page in df.columns:
        raise ValueError(f"there is a column {page} already")
    spark, by = df.sparkSession, F.col(f"`{key}`").asc_nulls_last()
    # an id has the range's number in its upper bits and the place in the range in the lower 33
    dealt = df.repartitionByRange(by).sortWithinPartitions(by).withColumn(page, F.monotonically_increasing_id())
    path = hadoop.scratch(spark, "pages")
    dealt.write.parquet(path)
    placed = spark.read.schema(dealt.schema).parquet(path)
    part = F.shiftright(F.col(f"`{page}`"), 33)
    before, total = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        before.append((r[0], total))
        total += r[1]
    ranges = spark.createDataFrame(before, "_part long, _before long")
    at = F.col("_before") + F.col(f"`{page}`").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(ranges), part == F.col("_part")).select(*(F.col(f"`{c}`") for c in df.columns), F.floor(at / F.lit(size)).cast("long").alias(page))


def keyset(df: DataFrame, key: str, size: int = CHUNK) -> Iterator[DataFrame]:
    """Pages of up to ``size`` rows in the order of a unique key; null is on the last one.

    A page is a range of the key, so that a source reads that range; where the
    ranges end is found for all pages at once. The driver has a key a page. For
    all pages of a table together see ``paged``, which reads it once.
    """
    numbered = paged(df.select(F.col(f"`{key}`").alias("k")), "k", size)
    tops = [r.top for r in numbered.groupBy("page").agg(F.max("k").alias("top")).orderBy("page").collect()]
    for path in {f.rsplit("/", 1)[0] for f in numbered.inputFiles()}:
        hadoop.delete(df.sparkSession, path)
    c, last = F.col(f"`{key}`"), None
    ends = [t for t in tops if t is not None]
    for k, top in enumerate(ends):
        inside = c <= F.lit(top) if last is None else (c > F.lit(last)) & (c <= F.lit(top))
        yield df.where(inside | c.isNull() if k == len(ends) - 1 else inside)
        last = top
    if tops and not ends:
        yield df.where(c.isNull())


def described(df: DataFrame, most: int = 10_000) -> dict[str, Any]:
    """Types, and the row count up to a bound."""
    n = df.limit(most + 1).count()
    return {"columns": dict(df.dtypes), "rows": min(n, most), "more": n > most}
