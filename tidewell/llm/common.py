"""What the corpus operators share: tables, shared folders, sizing and Arrow helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE = 1024


#: While a table is written, Arrow batches have at most 1,000 rows, which may hold long texts.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, of ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a folder of its own; on a cluster
    no folder of one machine would do, so that is an error.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_ = sc._jsc.sc().getCheckpointDir()
        root = os.path.dirname(set_.get()) if set_.isDefined() else None
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(root)
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: its lineage ends here and lost executors don't recompute it."""
    path, conf = shared_dir(df.sparkSession, label), df.sparkSession.conf
    rows = conf.get(BATCH_ROWS)
    conf.set(BATCH_ROWS, str(min(int(rows), 1000) if int(rows) > 0 else 1000))
    try:
        df.write.parquet(path)
    finally:
        conf.set(BATCH_ROWS, rows)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame | None) -> None:
    """Delete the files of tables made by ``written`` that nothing reads any more."""
    for df in tables:
        if df is None:
            continue
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


#: Estimates from here on are those of plans whose sizes Spark doesn't know.
UNKNOWN = 1 << 50


def partitions(df: DataFrame, mb: int = 32, least: int = 1) -> int:
    """Enough partitions for about ``mb`` MB each, by the plan's estimated size, or by its rows' sizes where it has no estimate."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN:
        wide = [F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8) for f in df.schema]
        size = int(df.agg(F.sum(sum(wide[1:], wide[0]).cast("long"))).first()[0] or 0)
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (mb << 20) + 1, 200_000))


#: Bits of the map by which ``marked`` thins a table out; its words are a broadcast of bounded size.
MAP_BITS = 1 << 24


def marked(df: DataFrame, column: Column, values: DataFrame, *, other: bool = False) -> DataFrame:
    """The rows whose ``column`` may be among ``values`` (a column of its type), or with ``other`` those for which it can't be.

    Values set bits of a map of ``MAP_BITS`` by hash: at most MAP_BITS / 64
    words, however many the values. A full map lets all rows pass, so an exact
    join follows where it matters; null is not among any values.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    own, word, bits = fresh(df, "map_bit", "map_word", "map_bits")
    c = values.columns[0]
    words = values.where(F.col(c).isNotNull()).select(bit(F.col(c)).alias("b")).groupBy(F.expr("b DIV 64").alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b % 64 AS INT))")).alias(bits))
    rows = df.withColumn(own, F.when(column.isNotNull(), bit(column)))
    hit = F.expr(f"{own} DIV 64 = {word}") & F.expr(f"(shiftrightunsigned({bits}, CAST({own} % 64 AS INT)) & 1L) = 1L")
    return rows.join(F.broadcast(words), hit, "left_anti" if other else "left_semi").drop(own)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores before them as ``df`` has no column of."""
    lead, taken = "_", {c.lower() for c in df.columns}
    while any(lead + n in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE, mb: float = 2.0) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most ``rows`` rows and, but for single rows, about ``mb`` MB, to bound what Python objects hold."""
    for batch in batches:
        at, step = 0, rows
        if batch.num_rows:
            step = min(rows, max(1, int(mb * 1e6 * batch.num_rows / max(1, batch.nbytes))))
        while at < batch.num_rows:
            piece = batch.slice(at, step)
            while piece.num_rows > 1 and piece.nbytes > 4 * mb * 1e6:
                piece = piece.slice(0, (piece.num_rows + 1) // 2)
            yield piece
            at += piece.num_rows


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


_LAST: list[dict | None] = [None]


def sole(memo: dict) -> None:
    """Make ``memo`` the one memo that this worker keeps: workers go from one operator to the next."""
    if _LAST[0] is not memo and _LAST[0] is not None:
        _LAST[0].clear()
    _LAST[0] = memo


class Cache(dict):
    """A bounded memo: emptied when full, so a worker's memory doesn't grow with its input."""

    def __init__(self, most: int = 250_000):
        self.most = most

    def room(self, n: int) -> None:
        if len(self) + n > self.most:
            self.clear()

    def asked(self, distinct: list, learn) -> list:
        """The values of distinct keys; ``learn`` puts those of the keys that it is given into the memo."""
        found = list(map(self.get, distinct))
        if new := [k for k, x in zip(distinct, found, strict=True) if x is None]:
            if len(self) + len(new) > self.most:
                # what is asked for now stays: it has the frequent keys
                kept = {k: x for k, x in zip(distinct, found, strict=True) if x is not None}
                self.clear()
                self.update(kept)
            learn(new)
            found = list(map(self.__getitem__, distinct))
        return found


def gathered(lists: pa.ListArray, value, kind: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """Each distinct piece's value, in the order of the pieces in ``lists``, and where each list ends after the first's beginning.

    ``value`` gets the distinct pieces and gives their values.
    """
    coded = lists.flatten().dictionary_encode()
    return pa.array(value(coded.dictionary.to_pylist()), kind).take(coded.indices), lists.offsets.to_numpy() - lists.offsets[0].as_py()
