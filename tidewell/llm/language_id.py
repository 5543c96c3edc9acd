"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text's words are its runs of letters, in small letters, with a mark before and
after; features are their runs of 1 to ``ORDERS`` characters, hashed into
``BUCKETS``. Tasks count them for each language over all texts to learn from;
Spark adds the counts up. The matrix of log probabilities, languages by
buckets, is broadcast, and batches of texts are scored in numpy: each feature's
row of the matrix is looked up and summed by document.

Nothing is sampled: counts cover all learning texts, predictions all texts, and
both whole texts. The matrix has 512 KB a language; more than ``MOST_LANGUAGES``
values of the language column are an error, as no column of languages has that
many. Texts are worked on in pieces of about a million characters, cut between
words (a longer word is cut).

Defined results: ``und`` with score 0 where a text is null or has no letter, or
where nothing was learnt; a null language isn't learnt from; equal scores go to
the language that sorts first; a null id counts as the text "" in the held-out
rule; repeated rows are predicted alike; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

ORDERS = 3
BUCKETS = 1 << 16
SMOOTHING = 0.1
MOST_LANGUAGES = 512
UNDETERMINED = "und"
#: Characters of texts that are worked on at once.
PIECE = 1_000_000
#: Languages whose counts a task holds at once.
HELD = 32
_SHIFT = np.uint64(64 - 16)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_GAP = re.compile(r"[\W\d_]")


@functools.cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _cut(text: str, piece: int) -> Iterator[str]:
    """The text in pieces of about ``piece`` characters that begin and end between words."""
    at = 0
    while len(text) - at > piece:
        gap = _GAP.search(text, at + piece, at + 2 * piece)
        end = gap.start() if gap else min(len(text), at + 2 * piece)
        yield text[at:end]
        at = end
    yield text[at:]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of short texts, and the number of each one's text. A text's come together, by order."""
    parts = [f"\n{t.lower()}\n" for t in texts]
    raw = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    codes = np.where(_letters()[raw], raw, 0)
    kept = codes != 0
    kept[1:] |= codes[:-1] != 0
    kept[starts] = True
    c = codes[kept].astype(np.uint64)
    owner = np.repeat(np.arange(len(parts)), np.diff(np.append(np.cumsum(kept)[starts] - 1, len(c))))
    letter = c != 0
    h = c * _ODD[0]
    found, whose = [((h ^ (h >> np.uint64(29))) * _ODD[2] >> _SHIFT)[letter]], [owner[letter]]
    if len(c) > 1:
        two = (h[:-1] + c[1:]) * _ODD[1]
        real = letter[:-1] | letter[1:]
        found.append(((two ^ (two >> np.uint64(31))) * _ODD[2] >> _SHIFT)[real])
        # of a mark and a letter both are of one text, as each text has marks of its own
        whose.append(owner[:-1][real])
    if len(c) > 2:
        three = (two[:-1] + c[2:]) * _ODD[0]
        real = letter[1:-1]
        found.append(((three ^ (three >> np.uint64(32))) * _ODD[2] >> _SHIFT)[real])
        whose.append(owner[:-2][real])
    return np.concatenate(found).astype(np.int64), np.concatenate(whose)


def _groups(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Numbers and pieces of texts, at most about ``PIECE`` characters (or one piece) at a time."""
    rows, held, size = [], [], 0
    for k, text in enumerate(texts):
        for piece in _cut(text or "", PIECE):
            if held and size + len(piece) > PIECE:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(k)
            held.append(piece)
            size += len(piece)
    if held:
        yield rows, held


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Languages in order, and log probabilities: a row a language, a column a bucket, with the prior last."""

    languages: tuple[str, ...]
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        n, k = len(texts), len(self.languages)
        totals, seen = np.zeros((k, n)), np.zeros(n, np.int64)
        for rows, pieces in _groups(texts):
            buckets, whose = grams(pieces)
            owner = np.asarray(rows)[whose]
            seen += np.bincount(owner, minlength=n)
            for j in range(k):
                totals[j] += np.bincount(owner, self.matrix[j][buckets], n)
        if not k:
            return [(UNDETERMINED, 0.0)] * n
        totals += self.matrix[:, -1:]
        best = totals.argmax(0)
        score = 1 / np.exp(totals - totals.max(0)).sum(0)
        return [(self.languages[b], float(s)) if m else (UNDETERMINED, 0.0) for b, s, m in zip(best, score, seen, strict=True)]


def _counts(batches):
    """(language, bucket, n) of a task's texts; bucket -1 counts the texts."""
    held: dict[str, np.ndarray] = {}

    def out():
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array((at - 1).astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for part in common.slices([batch]):
            texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
            here = sorted(set(langs))
            code = {lang: k for k, lang in enumerate(here)}
            for lo in range(0, len(here), HELD):
                some = here[lo : lo + HELD]
                if len(held.keys() | set(some)) > HELD:
                    yield from out()
                mine = [k for k, lang in enumerate(langs) if lo <= code[lang] < lo + HELD]
                own = np.array([code[langs[k]] - lo for k in mine])
                total = np.bincount(own * (BUCKETS + 1), minlength=len(some) * (BUCKETS + 1))
                for rows, pieces in _groups([texts[k] for k in mine]):
                    buckets, whose = grams(pieces)
                    total += np.bincount(own[np.asarray(rows)[whose]] * (BUCKETS + 1) + buckets + 1, minlength=len(total))
                for lang, n in zip(some, total.reshape(len(some), -1), strict=True):
                    held[lang] = held[lang] + n if lang in held else n
    yield from out()


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of all texts with a language that aren't held out."""
    own = docs.where(F.col(lang_col).isNotNull() & ~held_out(F.col(id_col))).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    counts = common.written(own.mapInArrow(_counts, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    languages = [r.lang for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"{lang_col} has more than {MOST_LANGUAGES} values")
    table = counts.toArrow()  # at most a row for each language and bucket
    names = tuple(sorted(languages))
    n = np.zeros((len(names), BUCKETS + 1))
    at = {lang: k for k, lang in enumerate(names)}
    lang = table["lang"].combine_chunks().dictionary_encode()
    row = np.array([at[x] for x in lang.dictionary.to_pylist()], np.int64)
    if len(table):
        n[row[lang.indices.to_numpy()], table["bucket"].to_numpy()] = table["n"].to_numpy()  # -1, the texts, is the last
    grams_, texts = n[:, :-1], n[:, -1]
    n[:, :-1] = np.log((grams_ + SMOOTHING) / (grams_.sum(1, keepdims=True) + SMOOTHING * BUCKETS))
    n[:, -1] = np.log(texts / max(1, texts.sum()))
    common.dropped(counts)
    return Model(names, n)


def predictions(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.matrix))

    def run(batches):
        own = Model(*shared.value)
        for batch in batches:
            for part in common.slices([batch]):
                found = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    got = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


# ------------------------------------------------------------------- query
def op13_language_bayes(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predictions(docs, train(docs))
