"""Token counts by merging ragged arrays of symbols rank by rank.

Pre-tokens of a batch lie end to end in one array of symbols. In each step
every sequence that still has a mergeable pair applies its pair of the lowest
rank, all sequences at once, and the array is compacted; the symbols that
survive are counted. Where no piece can outrank one of its own parts, all
occurrences of a sequence's lowest pair merge in the same step; otherwise only
the leftmost one does, as one-at-a-time merging would. A pre-token of over
``LONG`` symbols would take many such steps: its pairs lie in a heap by rank and
place, and it costs O(n log n).

Defined results: a null or empty text has 0 bytes and 0 tokens; a character
that the vocabulary lacks counts one token for each of its UTF-8 bytes; rows
that repeat are counted each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import heapq
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: Fixed value: the character that stands for a blank.
BLANK = "▁"
_NONE = np.iinfo(np.int64).max
LONG = 128
#: Pre-tokens that a worker remembers, about 0.2 kB each.
MEMO = 800_000


class PieceCounter:
    """Counts tokens as a ``sentencepiece`` BPE model with byte fallback gives them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.model = model
        usable = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.id = {model.id_to_piece(i): i for i in usable}
        score = {p: model.get_score(i) for p, i in self.id.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[s] for p, s in score.items()}
        joins, unsafe = [], set()
        for piece in self.id:
            for cut in range(1, len(piece)):
                a, b = piece[:cut], piece[cut:]
                if a in self.id and b in self.id:
                    joins.append((self.id[a] * model.vocab_size() + self.id[b], rank[piece], self.id[piece]))
                    unsafe |= {x for x in (a, b) if rank[piece] <= rank[x]}
        joins.sort()
        self.size = model.vocab_size()
        self.merges = {k: (r, m) for k, r, m in joins}
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*joins, strict=True))
        self.safe = np.ones(self.size, bool)
        self.safe[[self.id[p] for p in unsafe]] = False
        # pre-tokens end before a blank and around characters that no longer piece holds
        if any(BLANK in p.lstrip(BLANK) for p in self.id) or any("\n" in p for p in self.id):
            raise ValueError("pieces of this model cross the borders of pre-tokens")
        prefix = model.encode(f"{BLANK}a", out_type=str), model.encode("a", out_type=str)
        self.prefix = BLANK if prefix[1] and prefix[1][0].startswith(BLANK) else ""
        self.words = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n+")
        self.memo = common.Cache(MEMO)

    def _ranks(self, a: np.ndarray, b: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = same & (a >= 0) & (b >= 0) & (self.keys[at] == key)
        return np.where(hit, self.ranks[at], _NONE), self.made[at]

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        get, total = self.id.get, np.zeros(len(words), np.int64)
        size = np.array([len(w) for w in words])
        sym = np.array([get(c, -1) for c in chain.from_iterable(words)], np.int64)
        seq = np.repeat(np.arange(len(words)), size)
        if (lost := np.flatnonzero(sym < 0)).size:  # bytes of unknown characters beyond the one symbol they have
            text = "".join(words)
            np.add.at(total, seq[lost], [len(text[i].encode()) - 1 for i in lost.tolist()])
        while len(sym):
            rank, made = self._ranks(sym[:-1], sym[1:], seq[:-1] == seq[1:])
            rank, made = np.append(rank, _NONE), np.append(made, -1)
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, starts)
            done = np.repeat(low == _NONE, np.diff(np.r_[starts, len(seq)]))
            if done.any():  # sequences without a pair leave with what they have
                np.add.at(total, seq[done], 1)
                keep = ~done
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
                low = low[low != _NONE]
            lengths = np.diff(np.r_[starts, len(seq)])
            at = np.flatnonzero(rank == np.repeat(low, lengths))
            first = np.r_[True, seq[at][1:] != seq[at][:-1]]
            chosen = first | self.safe[made[at]]
            if not first.all():
                # of pairs that overlap in a row, every second one merges; after an unsafe first, none
                lead = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                chosen &= first | self.safe[made[at][lead]]
                at, first = at[chosen], first[chosen]
                new = np.r_[True, (at[1:] != at[:-1] + 1) | first[1:]]
                begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return total

    def long_count(self, word: str) -> int:
        """Tokens of one pre-token, its pairs in a heap."""
        n, size, pair = len(word), self.size, self.merges.get
        lost = -size * size  # a character without a piece: no pair with it has a key of a merge
        sym = [self.id.get(c, lost) for c in word]
        total = n + sum(len(c.encode()) - 1 for c, x in zip(word, sym, strict=True) if x == lost)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        keys = [a * size + b for a, b in zip(sym, sym[1:], strict=False)]
        heap = [got[0] << 32 | i for i, k in enumerate(keys) if (got := pair(k)) is not None]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            if sym[i] is None or (j := after[i]) >= n:
                continue
            got = pair(sym[i] * size + sym[j])
            if got is None or got[0] != top >> 32:
                continue  # an older pair of this place
            total -= 1
            sym[i], sym[j] = got[1], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (got := pair(sym[i] * size + sym[k])) is not None:
                    heapq.heappush(heap, got[0] << 32 | i)
            if (k := before[i]) >= 0 and (got := pair(sym[k] * size + sym[i])) is not None:
                heapq.heappush(heap, got[0] << 32 | k)
        return total

    def _learn(self, new: list[str]) -> None:
        new = sorted(new, key=len)
        while new and len(new[-1]) > LONG:
            self.memo[new[-1]] = self.long_count(new[-1])
            new.pop()
        at = 0
        while at < len(new):  # blocks of like length, about a million symbols each
            block = max(1, min(100_000, 1_000_000 // max(1, len(new[at]))))
            part = new[at : at + block]
            while len(part) > 1 and len(part[-1]) > 4 * len(part[0]) + 16:
                part = part[: len(part) // 2]
            self.memo |= zip(part, self.counts(part).tolist(), strict=True)
            at += len(part)

    #: A control character that is put where texts are cut.
    MARK = "\0"

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: its distinct pre-tokens are looked up, or counted, once."""
        if not texts:
            return []
        odd = {k: self.words.findall(self.prefix + t.replace(" ", BLANK)) for k, t in enumerate(texts) if self.MARK in t}
        rows = pa.array(["" if k in odd or not t else self.prefix + t for k, t in enumerate(texts)], pa.string())
        rows = pc.replace_substring_regex(pc.replace_substring(rows, " ", BLANK), f"({BLANK}+)", f"{self.MARK}\\1")
        lists = pc.split_pattern(pc.replace_substring_regex(rows, "(\n+)", f"{self.MARK}\\1{self.MARK}"), self.MARK)
        n, ends = common.gathered(lists, lambda distinct: self.memo.asked(distinct, self._learn), pa.int64())
        total = np.concatenate([[0], np.cumsum(n.to_numpy())])
        out = (total[ends[1:]] - total[ends[:-1]]).tolist()
        for k, pieces in odd.items():
            out[k] = sum(self.memo.asked(pieces, lambda new: self._learn(list(set(new)))))
        return out


@functools.lru_cache(1)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def counter(path: str) -> PieceCounter:
    found = _counter(path)
    common.sole(found.memo)
    return found


def count_tokens(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the count is over ``limit``."""

    def run(batches):
        pieces = counter(path)
        for part in common.slices(batches):
            texts = [t or "" for t in part.column(1).to_pylist()]
            counts = np.array(pieces.count(texts), np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts), pa.array(counts > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


# ------------------------------------------------------------------- query
def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
