"""Benchmark decontamination: BM25 retrieval of test items by training passages.

The test items are an inverted index; every passage of every document is a
query. A term's weight in an item is its BM25 weight over the item's whole
weight, so a passage's score is the share of the item that it holds, and one
threshold fits all items. Retrieval is block-max WAND and returns every item at
or above the threshold: bounds of all passages of a batch on all blocks of
items come first, at once, from the blocks' largest weights; a passage with a
block at or above the threshold is then walked by the pivot rule, where blocks
below the threshold are skipped unread. What is retrieved is verified: the
item's question and its answer must each be found, in order, in the passage.

The index is held in blocks of at most ``INDEX_BYTES`` of item text, in flat
arrays; larger benchmarks take a pass over the documents for each. Words are
counted over all items by the words that texts are cut into, so scores don't
depend on the blocks.

Defined results: a document without words holds no passage; an item without
words matches nothing; an item of fewer than ``SHORT`` words must occur word
for word; items or rows that repeat are each reported; equal scores all stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

WORD = re.compile(r"\w+")
INDEX_BYTES = 8 << 20
#: Items of a block of the index: whole items are short, so that a block of more would bound them badly.
BLOCK = 2
SHORT = 8
K1, B = 1.2, 0.75


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def parts(item: list[str], text: str) -> int:
    """Words of the question: up to the last question mark, or three quarters."""
    if "?" in text and 0 < (n := len(words(text[: text.rindex("?")]))) < len(item):
        return n
    return max(1, len(item) * 3 // 4)


def common_run(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit a word of ``a``."""
    places: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        places[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := places.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


@dataclass
class Tier:
    """Items of like length: windows, and postings in flat arrays, a term's from ``first[t]`` to ``first[t + 1]``."""

    stride: int
    items: list[int]
    first: np.ndarray
    place: np.ndarray  # items' places
    weight: np.ndarray
    block_first: np.ndarray  # of the blocks that hold a term
    block: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray
    wide: np.ndarray  # terms in over half of the blocks

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each term's places and weights."""
        return [(self.place[a:b], self.weight[a:b]) for a, b in zip(self.first, self.first[1:], strict=False)]

    @property
    def blocks(self) -> int:
        return (len(self.items) + BLOCK - 1) // BLOCK


class Cursor:
    """A place in a term's postings."""

    def __init__(self, tier: Tier, term: int):
        a, b = tier.first[term], tier.first[term + 1]
        self.place, self.weight, self.end = tier.place[a:b], tier.weight[a:b], len(tier.items)
        a, b = tier.block_first[term], tier.block_first[term + 1]
        self.block, self.block_max, self.most = tier.block[a:b], tier.block_max[a:b], float(tier.term_max[term])
        self.at = 0

    @property
    def doc(self) -> int:
        return int(self.place[self.at]) if self.at < len(self.place) else self.end

    def bound(self, block: int) -> float:
        i = int(np.searchsorted(self.block, block))
        return float(self.block_max[i]) if i < len(self.block) and self.block[i] == block else 0.0

    def skip(self, doc: int) -> None:
        self.at += int(np.searchsorted(self.place[self.at :], doc))


class Index:
    """BM25 index of test items with block maxima."""

    def __init__(self, items: list[tuple[int, str]], n_items: int, document_counts: dict[str, int], mean_length: float):
        tokens = [words(t) for _, t in items]
        keep = [k for k, w in enumerate(tokens) if w]
        self.ids = [items[k][0] for k in keep]
        self.cut = [parts(tokens[k], items[k][1]) for k in keep]
        self.term = {w: t for t, w in enumerate(sorted(set(chain.from_iterable(tokens))))}
        #: The items' words as terms.
        self.words = [np.array([self.term[w] for w in tokens[k]], np.int32) for k in keep]
        n = np.array([document_counts[w] for w in self.term], float)
        idf = np.log(1 + (n_items - n + 0.5) / (n + 0.5))
        by_tier = defaultdict(list)
        for k, w in enumerate(self.words):
            by_tier[max(64, 4 ** math.ceil(math.log(len(w), 4) - 1e-9))].append(k)
        self.tiers = [self._tier(stride, ks, idf, mean_length) for stride, ks in sorted(by_tier.items())]

    def _tier(self, stride: int, ks: list[int], idf: np.ndarray, mean: float) -> Tier:
        v, size = len(self.term), np.array([len(self.words[k]) for k in ks])
        keys, c = np.unique(np.repeat(np.arange(len(ks)), size) * v + np.concatenate([self.words[k] for k in ks]), return_counts=True)
        place, term = keys // v, keys % v
        w = idf[term] * c * (K1 + 1) / (c + K1 * (1 - B + B * size[place] / mean))
        w /= np.bincount(place, w)[place]
        order = np.lexsort((place, term))
        place, term, w = place[order], term[order], w[order]
        first = np.searchsorted(term, np.arange(v + 1))
        start = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (place[1:] // BLOCK != place[:-1] // BLOCK)])
        block_max = np.maximum.reduceat(w, start)
        block_first = np.searchsorted(term[start], np.arange(v + 1))
        term_max = np.zeros(v)
        np.maximum.at(term_max, term[start], block_max)
        wide = np.diff(block_first) * 2 > (len(ks) + BLOCK - 1) // BLOCK
        return Tier(stride, ks, first, place.astype(np.int32), w, block_first, (place[start] // BLOCK).astype(np.int32), block_max, term_max, wide)

    # ------------------------------------------------------------ retrieval
    @staticmethod
    def wand(tier: Tier, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """Every item whose score by these terms is at least ``theta``: block-max WAND."""
        end, found = len(tier.items), []
        lists = [c for c in (Cursor(tier, t) for t in terms) if c.doc < end]
        while lists:
            lists.sort(key=lambda c: c.doc)
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c.most
                if bound >= theta - 1e-9:
                    pivot = k
                    break
            if pivot < 0 or (doc := lists[pivot].doc) >= end:
                break
            while pivot + 1 < len(lists) and lists[pivot + 1].doc == doc:
                pivot += 1
            block = doc // BLOCK
            if sum(c.bound(block) for c in lists[: pivot + 1]) < theta - 1e-9:
                # no item of this block can reach the threshold by these lists
                to = min((block + 1) * BLOCK, lists[pivot + 1].doc if pivot + 1 < len(lists) else end)
                for c in lists[: pivot + 1]:
                    c.skip(max(to, doc + 1))
            elif lists[0].doc == doc:
                score = sum(float(c.weight[c.at]) for c in lists[: pivot + 1])
                if score >= theta - 1e-9:
                    found.append((doc, score))
                for c in lists[: pivot + 1]:
                    c.at += 1
            else:
                for c in lists[:pivot]:
                    c.skip(doc)
            lists = [c for c in lists if c.doc < end]
        return found

    def survivors(self, tier: Tier, window: np.ndarray, term: np.ndarray, n: int, theta: float) -> np.ndarray:
        """Windows whose bound on some block reaches the threshold; the pairs are distinct and ordered by window.

        Only blocks that hold a term of a window, but for terms of most blocks,
        are added up for it; those terms count with their largest weight.
        """
        base = np.bincount(window, np.where(tier.wide[term], tier.term_max[term], 0.0), n)
        keep = base >= theta - 1e-9
        # who can't reach the threshold with all terms' largest weights has no block to look at
        most = np.bincount(window, tier.term_max[term], n)
        go = ~tier.wide[term] & ((most >= theta - 1e-9) & ~keep)[window]
        window, term = window[go], term[go]
        size = (tier.block_first[1:] - tier.block_first[:-1])[term]
        ends = np.cumsum(size)
        lo = 0
        while lo < len(size):
            # some windows at a time, whole ones, to bound memory
            hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right"))
            hi = int(np.searchsorted(window, window[min(max(hi, lo + 1), len(window)) - 1], "right"))
            s, first, w = size[lo:hi], window[lo], window[lo:hi]
            at = np.repeat(tier.block_first[term[lo:hi]] - np.cumsum(s) + s, s) + np.arange(s.sum())
            key, value = np.repeat(w - first, s) * tier.blocks + tier.block[at], tier.block_max[at]
            cells = int(w[-1] - first + 1) * tier.blocks
            if cells <= 4 * len(key) + 1000:
                bound = np.bincount(key, value, cells)
                hit = np.flatnonzero(bound + np.repeat(base[first : w[-1] + 1], tier.blocks) >= theta - 1e-9)
            else:
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                hit = key[start]
                hit = hit[np.add.reduceat(value[order], start) + base[first + hit // tier.blocks] >= theta - 1e-9]
            keep[first + hit // tier.blocks] = True
            lo = hi
        return np.flatnonzero(keep)


class Codes(dict):
    """Memo of blank-delimited pieces: the term a piece holds, or a code below 0."""

    #: Codes: a word that no item has, no word, and below it the places in ``several`` of pieces with several words.
    OTHER, EMPTY = -1, -2

    def __init__(self, term: dict[str, int], most: int = 250_000):
        self.term, self.most = term, most
        self.several: list[list[int]] = []

    def clear(self) -> None:
        super().clear()
        self.several.clear()

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def __missing__(self, piece: str) -> int:
        low = piece.lower()
        code = self.term.get(low, self.OTHER)
        if code < 0 and not low.isalpha():
            w = WORD.findall(low)
            if len(w) == 1:
                code = self.term.get(w[0], self.OTHER)
            elif not w:
                code = self.EMPTY
            else:
                self.several.append([self.term.get(x, self.OTHER) for x in w])
                code = self.EMPTY - len(self.several)
        self[piece] = code
        return code


class Scanner:
    """Turns texts into passages and finds the items they leak."""

    def __init__(self, index: Index, theta: float, overlap: float):
        self.index, self.theta, self.overlap = index, theta, overlap
        self.memo = Codes(index.term)

    def _codes(self, pieces: list[str]) -> np.ndarray:
        codes = np.fromiter(map(self.memo.__getitem__, pieces), np.int64, len(pieces))
        if len(codes) and codes.min() <= Codes.EMPTY:
            if (codes < Codes.EMPTY).any():
                out = []
                for c in codes.tolist():
                    out.extend(self.memo.several[Codes.EMPTY - c - 1] if c < Codes.EMPTY else (c,))
                codes = np.array(out, np.int64)
            codes = codes[codes != Codes.EMPTY]
        return codes

    def scan(self, texts: list[str | None]) -> list[dict[int, tuple[float, float, float]]]:
        """For each text: item place to (score, question overlap, answer overlap)."""
        split = [t.replace("\n", " ").split(" ") if t else [] for t in texts]
        self.memo.trim()
        codes = [self._codes(s) for s in split]
        found: list[dict] = [{} for _ in texts]
        size = np.array([len(c) for c in codes])
        flat = np.concatenate([*codes, np.zeros(0, np.int64)])
        position = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        for tier in self.index.tiers:
            # window w of a text holds its segments w and w + 1
            segments = -(-size // tier.stride)
            windows = np.maximum(segments - 1, (segments > 0).astype(int))
            begin = np.cumsum(windows) - windows
            hit = np.flatnonzero(flat >= 0)
            text = np.repeat(np.arange(len(texts)), size)[hit]
            seg, term = position[hit] // tier.stride, flat[hit]
            v = len(self.index.term)
            later, sooner = seg < windows[text], seg > 0
            keys = np.unique(np.concatenate([(begin[text] + seg)[later] * v + term[later], (begin[text] + seg - 1)[sooner] * v + term[sooner]]))
            window, term = keys // v, keys % v
            n = int(windows.sum())
            if not n:
                continue
            owner = np.repeat(np.arange(len(texts)), windows)
            for w in self.index.survivors(tier, window, term, n, self.theta).tolist():
                a, b = np.searchsorted(window, [w, w + 1])
                doc = int(owner[w])
                for place, score in self.index.wand(tier, term[a:b].tolist(), self.theta):
                    at = (w - int(begin[doc])) * tier.stride
                    k = tier.items[place]
                    q, r = self._overlaps(k, codes[doc][at : at + 2 * tier.stride].tolist())
                    if min(q, r) >= self.overlap and score > found[doc].get(k, (0.0,))[0]:
                        found[doc][k] = (score, q, r)
        return found

    def _verify(self, k: int, passage: list[str]) -> tuple[float, float]:
        return self._overlaps(k, [self.index.term.get(w, Codes.OTHER) for w in passage])

    def _overlaps(self, k: int, passage: list[int]) -> tuple[float, float]:
        """The shares of the item's question and of its answer that the passage (terms, or numbers below 0) holds in order."""
        item, cut = self.index.words[k].tolist(), self.index.cut[k]
        if len(item) < SHORT:
            whole = any(passage[i : i + len(item)] == item for i in range(len(passage) - len(item) + 1))
            return float(whole), float(whole)
        question, answer = item[:cut], item[cut:]
        return common_run(question, passage) / len(question), common_run(answer, passage) / len(answer) if answer else 1.0


# --------------------------------------------------------------- operators
def _indexes(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark's indexes, one a block of bounded text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.coalesce(text_col, F.lit("")).alias("text"))

    def counted(batches):
        # items by word, and below no word how many words there are
        for part in common.slices(batches):
            tokens = [words(t) for t in part.column(0).to_pylist()]
            n = Counter(chain.from_iterable(map(set, tokens)))
            yield pa.RecordBatch.from_arrays([pa.array([*n, None], pa.string()), pa.array([*n.values(), sum(map(len, tokens))], pa.int64())], names=["term", "n"])

    counts = common.written(items.select("text").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    n, size = items.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    total = (counts.where("term IS NULL").first() or (None, 0))[1]
    blocks = int(size // INDEX_BYTES + 1)
    spread = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    for b in range(blocks):
        rows = spread.where(F.col("block") == b).orderBy("item", "text").select("item", "text").collect()
        own = sorted({w for _, t in rows for w in words(t)})
        known = dict(counts.join(items.sparkSession.createDataFrame([(w,) for w in own], "term string"), "term", "left_semi").collect())
        yield Index([tuple(r) for r in rows], n, known, max(1.0, total / max(1, n)))


def _scanners(spark, benchmark: DataFrame, theta: float, overlap: float, id_col: str, text_col: str):
    for index in _indexes(benchmark, id_col, text_col):
        yield spark.sparkContext.broadcast(index), theta, overlap


_SCANNERS: dict[int, Scanner] = {}


def _scanner(shared, theta: float, overlap: float) -> Scanner:
    """A worker's scanner of a broadcast index; its memo lasts from task to task."""
    if (found := _SCANNERS.get(shared.value_id)) is None:
        _SCANNERS.clear()
        found = _SCANNERS[shared.value_id] = Scanner(shared.index.value, theta, overlap)
    common.sole(found.memo)
    return found


@dataclass
class _Shared:
    index: object
    value_id: str


def leaks(docs: DataFrame, benchmark: DataFrame, *, theta: float = 0.6, overlap: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, score, question_overlap, answer_overlap) of documents that hold test items."""
    spark, out = docs.sparkSession, None
    for value, t, o in _scanners(spark, benchmark, theta, overlap, item_id, item_text):
        shared = _Shared(value, common.uuid.uuid4().hex)

        def run(batches, shared=shared, t=t, o=o):
            scanner = _scanner(shared, t, o)
            for part in common.slices(batches):
                found = scanner.scan(part.column(1).to_pylist())
                rows = [(i, scanner.index.ids[k], *x) for i, f in zip(part.column(0).to_pylist(), found, strict=True) for k, x in sorted(f.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64() if c < 2 else pa.float64()) for c in range(5)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        got = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, item_id long, score double, question_overlap double, answer_overlap double")
        out = got if out is None else out.unionByName(got)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, theta: float = 0.6, overlap: float = 0.8, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    place = docs.columns.index(text_col)
    for value, t, o in _scanners(docs.sparkSession, benchmark, theta, overlap, item_id, item_text):
        shared = _Shared(value, common.uuid.uuid4().hex)

        def run(batches, shared=shared, t=t, o=o):
            scanner = _scanner(shared, t, o)
            for part in common.slices(batches):
                found = scanner.scan(part.column(place).to_pylist())
                yield part.filter(pa.array([not f for f in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


# ------------------------------------------------------------------- query
def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
