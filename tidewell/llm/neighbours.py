"""Nearest neighbours by additive quantisation.

A vector is the sum of one full-dimensional codeword from each of ``BOOKS``
codebooks, chosen by beam search over residuals; the squared norm of that sum
is stored with the codes. A query has a table of its inner products with all
codewords, so a coded vector's squared distance is its norm less twice a sum
of looked-up entries, in single precision. The best by that are ranked again by
exact distances on the original vectors, in double precision.

Codebooks are fitted on a bounded sample of the vectors (``TRAIN_ROWS``, by
smallest hash) and all vectors are coded. Queries are a stated set; their
blocks of ``BLOCK`` meet every partition of coded vectors in turn. Equal vectors
are one there, with their ``k`` + 1 smallest ids. The best looked up for a query
bound its k-th exact distance from above; a vector's looked-up distance less its
own quantisation error bounds its exact distance from below, and all that this
doesn't rule out are ranked exactly, so that each partition's ``k`` best are exact.

Defined results: vectors that are null, empty, zero, or hold a null or
non-finite component take no part, and neither do vectors of another than the
most frequent length; rows with the query's own id aren't its neighbours; an id
that repeats is listed once, with its nearest row; equal distances go by id; an
empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm import common

BOOKS, WORDS, BEAM = 16, 256, 2
TRAIN_ROWS = 6_000
#: Of a partition's vectors, so many and at least this share are ranked exactly before the bound of the rest is known.
RERANK, RERANK_SHARE = 400, 1 / 32
BLOCK = 1024


class AdditiveQuantiser:
    """Codebooks (books, words, dimensions)."""

    def __init__(self, books: np.ndarray):
        self.books = books.astype(np.float32)
        self.square = (self.books**2).sum(2)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 5, seed: int = 7) -> AdditiveQuantiser:
        """k-means on the residuals that the codebooks before leave."""
        rng, left, out = np.random.default_rng(seed), x.astype(np.float32).copy(), []
        for _ in range(books):
            k = min(words, len(left))
            c = left[rng.choice(len(left), k, replace=False)]
            for _ in range(rounds):
                own = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
                n = np.bincount(own, minlength=k)
                order = np.argsort(own, kind="stable")
                total = np.zeros_like(c)
                total[n > 0] = np.add.reduceat(left[order], (np.cumsum(n) - n)[n > 0])
                c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c).astype(np.float32)
            own = ((c**2).sum(1) - 2 * left @ c.T).argmin(1)
            left -= c[own]
            out.append(np.pad(c, ((0, words - k), (0, 0))))
        return cls(np.array(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the squared norms of what they stand for."""
        x = x.astype(np.float32)
        n = len(x)
        left, error = x[:, None, :], (x**2).sum(1)[:, None]
        codes = np.zeros((n, 1, 0), np.uint8)
        for book, square in zip(self.books, self.square, strict=True):
            cost = error[:, :, None] + square - 2 * (left.reshape(-1, x.shape[1]) @ book.T).reshape(n, left.shape[1], -1)
            flat, keep = cost.reshape(n, -1), min(beam, cost.shape[1] * cost.shape[2])
            best = np.argpartition(flat, keep - 1, 1)[:, :keep]
            row, word = best // cost.shape[2], best % cost.shape[2]
            left = np.take_along_axis(left, row[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
            error = np.take_along_axis(flat, best, 1)
        own = error.argmin(1)
        at = np.arange(n)
        return codes[at, own], ((x - left[at, own]) ** 2).sum(1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of queries and codewords: (queries, books, words)."""
        return np.einsum("qd,bwd->qbw", q.astype(np.float32), self.books, optimize=True)


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    return np.sqrt(((x.astype(np.float64) - q.astype(np.float64)) ** 2).sum(1))


def distances(q: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Exact distances of the rows ``at``, some at a time to bound memory."""
    return np.concatenate([np.zeros(0), *(exact(q, x[at[a : a + 8192]]) for a in range(0, len(at), 8192))])


def distinct(ids: np.ndarray, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct vectors, the up to ``most`` smallest ids of each in turn, and where those begin."""
    x = np.ascontiguousarray(x + 0.0)  # one zero
    _, first, own = np.unique(x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((ids, own))
    g, v = own[order], ids[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])]
    g, v = g[new], v[new]
    nth = np.arange(len(g)) - np.searchsorted(g, g)
    g, v = g[nth < most], v[nth < most]
    return x[first], v, np.searchsorted(g, np.arange(len(first) + 1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull())
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0].n if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


# --------------------------------------------------------------- operators
def search(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) of each query's ``k`` nearest."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    asked = usable(queries, id_col, vector_col).dropDuplicates(["id"])
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).toArrow()
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sample.num_rows:
        return none
    model = AdditiveQuantiser.fit(_matrix(sample["v"]))
    shared = spark.sparkContext.broadcast(model.books)
    # queries lie in the shared folder, a file a block, and are read block by block
    to = common.shared_dir(spark, "queries")
    n = asked.count()

    def store(batches):
        fs, root = common.filesystem(to)
        fs.create_dir(root, recursive=True)
        ids, vs = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            vs.append(_matrix(b.column(1)))
        if ids:
            name = f"{common.uuid.uuid4().hex}.npz"
            with fs.open_output_stream(f"{root}/.{name}", compression=None) as out:
                np.savez(_Out(out), ids=np.concatenate(ids), v=np.concatenate(vs))
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"block": [f"{to}/{name}"]})

    blocks = sorted(r.block for r in common.written(asked.repartition(max(1, -(-n // BLOCK))).mapInArrow(store, "block string"), "blocks").collect())

    def run(batches):
        aq = AdditiveQuantiser(shared.value)
        ids, vs = [], []
        for b in batches:
            ids.append(b.column(0).to_numpy(zero_copy_only=False))
            vs.append(_matrix(b.column(1)))
            if sum(map(len, ids)) >= 100_000:
                yield from found(aq, np.concatenate(ids), np.concatenate(vs))
                ids, vs = [], []
        if ids:
            yield from found(aq, np.concatenate(ids), np.concatenate(vs))

    def found(aq, ids, x):
        if not len(ids):
            return
        x, listed, begin = distinct(ids, x, k + 1)
        parts, error = [], []
        for a in range(0, len(x), 2048):
            parts.append(aq.encode(x[a : a + 2048]))
            stood = sum(book[word].astype(np.float64) for book, word in zip(aq.books, parts[-1][0].T, strict=True))
            error.append(np.sqrt(((x[a : a + 2048] - stood) ** 2).sum(1)))
        codes, norms = (np.concatenate(y) for y in zip(*parts, strict=True))
        error = np.concatenate(error)
        flat = codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * aq.books.shape[1]
        columns = [np.ascontiguousarray(c) for c in flat.T]

        def best(own: int, at: np.ndarray, d: np.ndarray) -> list[tuple[int, float]]:
            """The ``k`` nearest ids but ``own`` of the distinct vectors ``at``."""
            n = begin[at + 1] - begin[at]
            ids = listed[np.repeat(begin[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            d = np.repeat(d, n)
            seen: dict[int, float] = {}
            for o in np.lexsort((ids, d)).tolist():
                if ids[o] != own:
                    seen.setdefault(int(ids[o]), float(d[o]))
                    if len(seen) == k:
                        break
            return list(seen.items())

        for block in blocks:
            q_ids, q = _block(block)
            tables = aq.tables(q).reshape(len(q), -1)
            out: list[tuple] = []
            for i in range(len(q)):
                near = norms.copy()
                t = tables[i] * 2
                for c in columns:
                    near -= t[c]
                m = min(max(rerank, int(len(near) * RERANK_SHARE)), len(near))
                top = np.argpartition(near, m - 1)[:m]
                d = distances(q[i], x, top)
                got = best(int(q_ids[i]), top, d)
                kth = got[-1][1] if len(got) == k else np.inf
                # what looked-up sums may be off by rounding comes on top
                whole = float((q[i].astype(np.float64) ** 2).sum())
                slack = 2e-5 * (whole + norms + np.abs(t).reshape(len(columns), -1).max(1).sum())
                more = ~(near + whole > (kth + error) ** 2 + slack)
                more[top] = False
                rest = np.flatnonzero(more)
                if len(rest):
                    top, d = np.concatenate([top, rest]), np.concatenate([d, distances(q[i], x, rest)])
                    close = d <= kth
                    got = best(int(q_ids[i]), top[close], d[close])
                out += [(int(q_ids[i]), v, s) for v, s in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    near = rows.mapInArrow(run, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class _Out:
    """A write-only stream with a position, for numpy's writer."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def read(self, *_):
        raise OSError("write only")

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


@functools.lru_cache(4)
def _block(name: str) -> tuple[np.ndarray, np.ndarray]:
    import io

    fs, path = common.filesystem(name)
    with fs.open_input_file(path) as file:
        got = np.load(io.BytesIO(file.read()))
        return got["ids"], got["v"]


# ------------------------------------------------------------------- query
def op6_additive_quantisation(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0"))
