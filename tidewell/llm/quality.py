"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown by boosting on statistics of labelled texts. Every path
from a root is a rule, a conjunction of thresholds; a logistic regression with
a lasso penalty weighs rules and keeps few. The kept rules become one Spark
column expression, a sum of ``when`` terms under a sigmoid.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, those with the
smallest hash of their id; statistics and scores cover every text whole.

Defined results: a null text is an empty one, and an empty text has all
statistics 0 and is scored as such; without a label to learn from, all scores
are 0.5; labels of unknown documents are not used; a document labelled twice is
learnt twice; a null id counts as the text ""; an empty table gives no rows.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: The bound of the labelled sample.
TRAIN_ROWS = 8_000
THRESHOLD = 0.3

STATISTICS = ("log_words", "word_length", "long_words", "distinct_words", "repeats", "capitals", "stops", "commas", "bars", "marks", "shouts", "digits", "distinct_lines", "line_words")


def statistics(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text, in the order of ``STATISTICS``."""
    pieces = text.split() if text else []
    if not pieces:
        return (0.0,) * len(STATISTICS)
    n, chars, count = len(pieces), len(text), text.count
    lines = text.split("\n")
    lengths = list(map(len, pieces))
    return (
        float(np.log1p(n)),
        sum(lengths) / n,
        sum(map((14).__lt__, lengths)) / n,
        len(set(pieces)) / n,
        sum(map(operator.eq, pieces, pieces[1:])) / n,
        sum(map(str.isupper, pieces)) / n,
        count(".") / n,
        count(",") / n,
        count("|") / n,
        sum(map(count, "#$%&*@~^=<>{}[]_\\")) / n,
        (count("!") + count("?")) / n,
        sum(map(count, "0123456789")) / chars,
        len(set(lines)) / len(lines),
        n / len(lines) / (1 + n / len(lines)),
    )


# ------------------------------------------------------------------ fitting
Condition = tuple[int, bool, float]  # statistic, above (else at most), threshold


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], depth: int, least: int):
    """A regression tree on gradients, as (statistic, threshold, low, high) or a leaf's value."""
    value = g[rows].sum() / (h[rows].sum() + 1.0)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
        for f, cut in enumerate(cuts):
            if not len(cut):
                continue
            slot = np.searchsorted(cut, x[rows, f])  # 0: at most the first cut
            gs, hs, ns = (np.bincount(slot, w, len(cut) + 1).cumsum()[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(cut[k])))
    if best[1] is None:
        return value
    f, t = best[1]
    low = x[rows, f] <= t
    return f, t, _grow(x, g, h, rows[low], cuts, depth - 1, least), _grow(x, g, h, rows[~low], cuts, depth - 1, least)


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, _predict(low, x), _predict(high, x))


def _paths(tree, above: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    own = [tuple(sorted(above))] if above else []
    if not isinstance(tree, tuple):
        return own
    f, t, low, high = tree
    return own + _paths(low, (*above, (f, False, t))) + _paths(high, (*above, (f, True, t)))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, t in rule:
        out &= (x[:, f] > t) if above else (x[:, f] <= t)
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise mean log loss plus ``penalty`` times the weights' absolute sum (accelerated proximal gradient)."""
    n, k = r.shape
    w, b, v, c, t = np.zeros(k), float(np.log(y.mean() / (1 - y.mean()))), np.zeros(k), 0.0, 1.0
    c = b
    step = 4.0 / (np.linalg.norm(r, 2) ** 2 / n + 1.0)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        w2 = v - step * (r.T @ (p - y)) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2 = c - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[tuple[Condition, ...], ...]
    weights: tuple[float, ...]
    intercept: float

    def column(self, statistic) -> Column:
        """The score as a Spark column; ``statistic(k)`` gives the column of statistic ``k``."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            test = None
            for f, above, t in rule:
                one = statistic(f) > t if above else statistic(f) <= t
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, penalty: float = 5e-4) -> RuleModel:
    if not len(y):
        return RuleModel((), (), 0.0)
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel((), (), float(np.log(p / (1 - p))))
    order = np.lexsort((y, *x.T[::-1]))  # the same model whatever the order of the rows
    x, y = x[order], y[order]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 49)))[:] for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    margin, found, least = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}, max(5, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), cuts, depth, least)
        if not isinstance(tree, tuple):
            break
        margin += rate * _predict(tree, x)
        found |= dict.fromkeys(_paths(tree))
    rules, columns, seen = [], [], set()
    for rule in found:
        c = holds(rule, x)
        if 0 < c.sum() < len(c) and (key := c.tobytes()) not in seen:
            seen.add(key)
            rules.append(rule)
            columns.append(c)
    if not rules:
        return RuleModel((), (), float(np.log(y.mean() / (1 - y.mean()))))
    w, b = lasso_logistic(np.array(columns, np.float32).T, y.astype(np.float32), penalty)
    kept = [k for k in range(len(rules)) if abs(w[k]) > 1e-6]
    return RuleModel(tuple(rules[k] for k in kept), tuple(float(w[k]) for k in kept), float(b))


# --------------------------------------------------------------- operators
def with_statistics(df: DataFrame, prefix: str, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (its ``keep`` columns, or all) with a double column ``prefix + k`` for each statistic."""
    keep = df.columns if keep is None else keep
    names, place = [*keep, *([text_col] if text_col not in keep else [])], keep
    src = df.select(*names)
    at = names.index(text_col)

    def run(batches):
        for part in common.slices(batches):
            rows = np.array([statistics(t) for t in part.column(at).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(place)], *(pa.array(np.ascontiguousarray(c)) for c in rows.T)], names=[*place, *(f"{prefix}{k}" for k in range(len(STATISTICS)))])

    schema = src.select(*keep).schema
    for k in range(len(STATISTICS)):
        schema = schema.add(f"{prefix}{k}", "double")
    return src.mapInArrow(run, schema)


def crc_mod(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 5


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """A model of the labelled documents that are not held out.

    The sample of labels has at most ``rows`` rows, so that it may be broadcast
    and its statistics may come to the driver. Where ids of documents repeat, at
    most twice as many documents are learnt from, in the order of hashes too.
    """
    own = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & (crc_mod(F.col("_id")) != 0))
    sample = own.orderBy(F.xxhash64("_id"), "_id", "_y").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_h")).join(F.broadcast(sample), "_id")
    got = with_statistics(texts, "_s", text_col="_text", keep=["_y", "_id", "_h"])
    got = got.orderBy(F.xxhash64("_id"), "_id", "_h", "_y").limit(2 * rows).drop("_id", "_h").toArrow()
    data = np.column_stack([c.to_numpy() for c in got.columns]).reshape(-1, 1 + len(STATISTICS))
    return fit(data[:, 1:], (data[:, 0] > 0.5).astype(float))


def scores(docs: DataFrame, model: RuleModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    got = with_statistics(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "_s", keep=["doc_id"])
    score = got.select("doc_id", (crc_mod(F.col("doc_id")) == 0).alias("held_out"), model.column(lambda k: F.col(f"_s{k}")).alias("score"))
    return score.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def accepted(docs: DataFrame, model: RuleModel, *, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least ``THRESHOLD``, with all their columns."""
    prefix = "_s"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return with_statistics(docs, prefix, text_col=text_col).where(model.column(lambda k: F.col(f"{prefix}{k}")) >= THRESHOLD).select(*docs.columns)


# ------------------------------------------------------------------- query
def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return scores(docs, train(docs, common.table(spark, sf_dir, "labels")))
