"""Distances of array columns, as column expressions in double precision."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("cosine", "l2", "inner_product", "l1")


def _total(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - cos; l2: Euclidean; inner_product: the negative one; l1: sum of absolute differences."""
    if metric == "cosine":
        return 1 - _total(a, b, lambda x, y: x * y) / (F.sqrt(_total(a, a, lambda x, y: x * y)) * F.sqrt(_total(b, b, lambda x, y: x * y)))
    if metric == "l2":
        return F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y)))
    if metric == "inner_product":
        return -_total(a, b, lambda x, y: x * y)
    if metric == "l1":
        return _total(a, b, lambda x, y: F.abs(x - y))
    raise ValueError(f"{metric!r}: a metric is one of {', '.join(METRICS)}")


def nearest(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "cosine", id_col: str | None = None) -> DataFrame:
    """The ``k`` rows nearest to a vector, with their ``distance``; ties go by ``id_col``."""
    kind = df.schema[column].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType)):
        raise TypeError(f"{column} holds no vectors")
    q = F.array(*(F.lit(float(x)) for x in query))
    ties = [F.col(id_col).asc()] if id_col else []
    return df.withColumn("distance", distance(F.col(column), q, metric)).orderBy(F.col("distance").asc_nulls_last(), *ties).limit(k)


#: Queries that go to tasks at once, and base rows that are multiplied with them at once.
QUERY_BLOCK, BASE_BLOCK = 2_048, 1_024
#: Products differ from exact distances by less than this share of the norms.
_SLACK = 1e-9


def _exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows to rows, pair by pair."""
    if metric == "l2":
        return np.sqrt(((a - b) ** 2).sum(1))
    if metric == "l1":
        return np.abs(a - b).sum(1)
    dot = (a * b).sum(1)
    if metric == "inner_product":
        return -dot
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _rough(q: np.ndarray, b: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Values in the order of the distances of all queries to all of a batch, by one product, and a bound of their errors."""
    if metric == "l1":
        out = np.stack([np.abs(b - x).sum(1) for x in q])
        return out, np.full(out.shape, _SLACK) * (1 + out)
    dot = q @ b.T
    qq, bb = (q * q).sum(1)[:, None], (b * b).sum(1)[None]
    if metric == "l2":
        return qq + bb - 2 * dot, _SLACK * (qq + bb)
    if metric == "inner_product":
        return -dot, _SLACK * np.sqrt(qq * bb)
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dot / np.sqrt(qq * bb), np.full(dot.shape, _SLACK)


def _best(ids: np.ndarray, base: np.ndarray, q: np.ndarray, q_ids: np.ndarray, held: list, k: int, metric: str) -> None:
    """Put a batch's nearest among each query's ``held`` (distances, ids), smaller ids first in ties."""
    rough, error = _rough(q, base, metric)
    rough = np.where(ids[None] == q_ids[:, None], np.inf, rough)  # a query is no neighbour of itself
    at = min(k, rough.shape[1]) - 1
    bound = np.partition(rough + error, at, 1)[:, at]
    row, col = np.nonzero((rough - error <= bound[:, None]) & np.isfinite(rough))
    score = _exact(q[row], base[col], metric)
    cuts = np.searchsorted(row, np.arange(len(q) + 1))
    for j in range(len(q)):
        a, b = cuts[j], cuts[j + 1]
        if a == b:
            continue
        s, i = np.concatenate([held[j][0], score[a:b]]), np.concatenate([held[j][1], ids[col[a:b]]])
        order = np.lexsort((i, s))[:k]
        held[j] = (s[order], i[order])


def nearest_many(queries: DataFrame, base: DataFrame, column: str, id_col: str, k: int, metric: str = "cosine") -> DataFrame:
    """The ``k`` rows of ``base`` nearest to each row of ``queries``: query_id, rank, id and distance.

    Queries go to the tasks in blocks of at most ``QUERY_BLOCK``; each task
    multiplies a block with its Arrow batches and keeps the best ``k`` of each
    query, and Spark merges what the tasks kept. A block is a pass over ``base``.
    Distances are exact, in double precision, ties go to the smaller id, and a
    row is no neighbour of its own id. Ids are numbers, without nulls; vectors
    that are null, of another length than the block's first or hold null or
    non-finite values take no part, and neither do zero vectors for cosine.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric!r}: a metric is one of {', '.join(METRICS)}")
    fine = lambda df: df.where(F.col(column).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.size("v") > 0).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if metric == "cosine":
        own = fine
        fine = lambda df: own(df).where(F.exists("v", lambda x: x != 0))
    asked, rows, spark = fine(queries), fine(base), base.sparkSession
    out = None
    for block in _blocks(asked):
        shared = spark.sparkContext.broadcast(block)

        def score(batches, shared=shared):
            q_ids, q = shared.value
            held = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
            for batch in batches:
                for at in range(0, batch.num_rows, BASE_BLOCK):
                    part = batch.slice(at, BASE_BLOCK)
                    vectors = part.column(1)
                    same = np.diff(vectors.offsets.to_numpy()) == q.shape[1]
                    if not same.any():
                        continue
                    part = part.filter(pa.array(same))
                    flat = part.column(1).flatten().to_numpy()
                    _best(part.column(0).to_numpy(), flat.reshape(-1, q.shape[1]), q, q_ids, held, k, metric)
            n = [len(s) for s, _ in held]
            if sum(n):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([i for _, i in held])), pa.array(np.concatenate([s for s, _ in held]))], names=["query_id", "id", "distance"])

        found = rows.mapInArrow(score, "query_id long, id long, distance double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query_id long, id long, distance double")
    best = W.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries of one length, in blocks; the driver holds one at a time."""
    held: dict[int, list] = {}

    def pack(rows):
        return np.array([r.id for r in rows], np.int64), np.array([r.v for r in rows])

    for row in asked.toLocalIterator(prefetchPartitions=True):
        own = held.setdefault(len(row.v), [])
        own.append(row)
        if len(own) == QUERY_BLOCK:
            yield pack(own)
            own.clear()
    yield from (pack(own) for own in held.values() if own)
