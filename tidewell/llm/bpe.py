"""Byte-pair encoding with segment trees over adjacent pair ranks, and decoding.

A pre-token's bytes are symbols in a row; leaf ``i`` of its tree holds the rank
of the pair that begins at symbol ``i`` and its place, as one number, and every
inner node the smaller of its children. So the root is the leftmost pair of the
lowest rank. A merge changes three leaves and their ancestors; the work on a
pre-token of n bytes is O(n log n), however long it is. Many short pre-tokens
are merged side by side, a numpy row each; a long one has a tree of its own.

Defined results: a null or empty text has no ids and decodes to an empty text;
special strings inside a text become their special ids, as in the library; rows
that repeat are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: Fixed value: the splitting pattern of byte-level BPE files with use_regex.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters by themselves.
BLANKS = SPACE.encode().decode("unicode_escape")
#: A letter, and the marks after it at a word's end: the pattern always splits there, as it has no letters and marks in one but for 's and the like.
MARKS_END = f"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])([!-/:-@\\[-`{{-~]+)([{BLANKS}]|$)"
#: Pre-tokens of more bytes get a tree of their own.
LONG = 256
#: Pieces that a worker remembers, about 0.2 kB each.
MEMO = 600_000
_NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character to byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class SegmentTree:
    """Minimum over leaves, with point updates."""

    def __init__(self, leaves: list[int]):
        self.width = 1 << max(0, (len(leaves) - 1).bit_length())
        self.node = [_NONE] * self.width + leaves + [_NONE] * (self.width - len(leaves))
        for i in range(self.width - 1, 0, -1):
            a, b = self.node[2 * i], self.node[2 * i + 1]
            self.node[i] = a if a < b else b

    @property
    def root(self) -> int:
        return self.node[1]

    def put(self, leaf: int, value: int) -> None:
        node, i = self.node, leaf + self.width
        node[i] = value
        i >>= 1
        while i:
            a, b = node[2 * i], node[2 * i + 1]
            low = a if a < b else b
            if node[i] == low:
                break
            node[i] = low
            i >>= 1


class ByteBPE:
    """Vocabulary, merge ranks and memo of one tokenizer file."""

    def __init__(self, path: str, memo: int = MEMO):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.plain = [b""] * self.size
        for piece, i in vocab.items():
            self.plain[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for piece, i in self.special.items():
            self.plain[i] = piece.encode()
        self.pieces_of = pa.array(self.plain, pa.binary())
        self.byte_id = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_id[b] = vocab[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pair = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a * self.size + b for a, b in self.pair], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.array([r for r, _ in self.pair.values()], np.int64)[order]
        self.merged = np.array([m for _, m in self.pair.values()], np.int64)[order]
        self.words = regex.compile(SPLIT)
        # white space always begins a pre-token, so texts fall into pieces of blanks and what follows
        self.pieces = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = common.Cache(memo)

    # -------------------------------------------------- one long pre-token
    def merge_long(self, data: bytes) -> list[int]:
        ids, n = self.byte_id[np.frombuffer(data, np.uint8)].tolist(), len(data)
        get = self.pair.get
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        leaf = lambda i, j: _NONE if (p := get((ids[i], ids[j]))) is None else p[0] * n + i
        tree = SegmentTree([leaf(i, i + 1) for i in range(n - 1)] or [_NONE])
        while (low := tree.root) != _NONE:
            i = low % n
            j = after[i]
            ids[i] = get((ids[i], ids[j]))[1]
            k = after[i] = after[j]
            ids[j] = -1
            if j < n - 1:
                tree.put(j, _NONE)
            if k < n:
                before[k] = i
            if i < n - 1:
                tree.put(i, leaf(i, k) if k < n else _NONE)
            if (h := before[i]) >= 0:
                tree.put(h, leaf(h, i))
        return [i for i in ids if i >= 0]

    # ------------------------------------------- many pre-tokens side by side
    def _leaves(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (a >= 0) & (b >= 0) & (self.keys[at] == key)
        return np.where(hit, self.ranks[at] * width + place, _NONE), at

    def merge_many(self, data: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens of up to a common width."""
        size = np.array([len(d) for d in data])
        width, rows = 1 << max(1, int(size.max() - 1).bit_length()), len(data)
        sym = np.full((rows, width + 1), -1, np.int64)
        col = np.arange(width)
        sym[:, :width][col < size[:, None]] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        tree = np.full((rows, 2 * width), _NONE, np.int64)
        tree[:, width:] = self._leaves(sym[:, :width], sym[:, 1:], col[None, :], width)[0]
        for level in [width >> s for s in range(1, width.bit_length())]:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        after = np.broadcast_to(np.minimum(np.arange(1, width + 2), width), (rows, width + 1)).copy()
        before = np.broadcast_to(np.arange(-1, width), (rows, width + 1)).copy()

        def put(row, leaf, value):
            i = leaf + width
            tree[row, i] = value
            i = i >> 1
            while i[0]:
                tree[row, i] = np.minimum(tree[row, 2 * i], tree[row, 2 * i + 1])
                i = i >> 1

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            i = tree[live, 1] % width
            j = after[live, i]
            at = np.searchsorted(self.keys, sym[live, i] * self.size + sym[live, j])
            sym[live, i] = self.merged[at]
            k = after[live, j]
            sym[live, j] = -1
            after[live, i] = k
            before[live, k] = i
            put(live, np.minimum(j, width - 1), _NONE)
            put(live, i, self._leaves(sym[live, i], sym[live, k], i, width)[0])
            h = before[live, i]
            left = h >= 0
            if left.any():
                r, h = live[left], h[left]
                put(r, h, self._leaves(sym[r, h], sym[r, i[left]], h, width)[0])
            live = live[tree[live, 1] != _NONE]
        kept = sym[:, :width] >= 0
        blob, ends = sym[:, :width][kept].astype("<i4").tobytes(), (np.cumsum(kept.sum(1)) * 4).tolist()
        return [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge(self, tokens: set[bytes]) -> dict[bytes, bytes]:
        """Ids, as little-endian 32-bit integers, of distinct pre-tokens, in blocks of like width."""
        found, by_width = {}, {}
        for t in tokens:
            by_width.setdefault((len(t) - 1).bit_length(), []).append(t)
        for bits, group in by_width.items():
            if 1 << bits > LONG:
                found |= {t: np.array(self.merge_long(t), "<i4").tobytes() for t in group}
                continue
            block = max(1, (1 << 18) >> max(1, bits))
            for at in range(0, len(group), block):
                found |= zip(group[at : at + block], self.merge_many(group[at : at + block]), strict=True)
        return found

    # ------------------------------------------------------------- texts
    def _fill(self, new: list[str]) -> None:
        # a blank and letters are one pre-token; what else a piece holds, the pattern tells
        alone = {p: p.encode() for p in new if p[:1] == " " and p[1:].isalpha()}
        mixed = {p: [w.encode() for w in self.words.findall(p)] for p in new if p not in alone}
        found = self.merge({*alone.values(), *chain.from_iterable(mixed.values())})
        for p, w in alone.items():
            self.memo[p] = found[w]
        for p, ws in mixed.items():
            self.memo[p] = b"".join(map(found.__getitem__, ws))

    def _whole(self, text: str) -> bytes:
        """The ids of a text that holds special strings or the mark."""
        parts = self.specials.split(text) if self.specials else [text]
        pieces = [[p] if k % 2 else self.pieces.findall(p) for k, p in enumerate(parts)]
        known = dict(zip(own := list(set(chain.from_iterable(pieces[::2]))), self.memo.asked(own, self._fill), strict=True))
        return b"".join(np.array([self.special[p[0]]], "<i4").tobytes() if k % 2 else b"".join(map(known.__getitem__, p)) for k, p in enumerate(pieces))

    #: A control character that is put before blanks to cut texts there.
    MARK = "\0"

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each begins and the last ends. Distinct pieces are looked up, or merged, once."""
        odd = {k: t for k, t in enumerate(texts) if self.MARK in t or any(x in t for x in self.special)}
        rows = pa.array(["" if k in odd else t for k, t in enumerate(texts)], pa.string())
        rows = pc.replace_substring_regex(rows, MARKS_END, f"\\1{self.MARK}\\2\\3")
        lists = pc.split_pattern(pc.replace_substring_regex(rows, f"([{BLANKS}]+)", f"{self.MARK}\\1"), self.MARK)
        ids, ends = common.gathered(lists, lambda distinct: self.memo.asked(distinct, self._fill), pa.binary())
        values = np.frombuffer(ids.buffers()[2] or b"", "<i4")
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ends + ids.offset] // 4
        if odd:
            parts = [np.frombuffer(self._whole(odd[k]), "<i4") if k in odd else values[ends[k] : ends[k + 1]] for k in range(len(texts))]
            values, ends = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return values[ends[0] : ends[-1]], (ends - ends[0]).astype(np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        values, ends = self.encoded(texts)
        return [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decoded(self, values: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids that lie end to end."""
        pieces = self.pieces_of.take(pa.array(values))
        at = np.frombuffer(pieces.buffers()[1], np.int32)[ends + pieces.offset].tolist()
        data = memoryview(pieces.buffers()[2] or b"")
        return [str(data[a:b], "utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]

    def decode(self, ids) -> str:
        return b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(1)
def _tokenizer(path: str, memo: int) -> ByteBPE:
    return ByteBPE(path, memo)


def tokenizer(path: str, memo: int = MEMO) -> ByteBPE:
    found = _tokenizer(path, memo)
    common.sole(found.memo)
    return found


# --------------------------------------------------------------- operators
def encode(df: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False, memo: int = MEMO) -> DataFrame:
    """doc_id and token_ids of every text; with ``decoded`` also the text that the ids stand for, from the same worker.

    A worker remembers ``memo`` pieces: more take memory, fewer take time.
    """

    def run(batches):
        bpe = tokenizer(path, memo)
        for part in common.slices(batches):
            values, ends = bpe.encoded([t or "" for t in part.column(1).to_pylist()])
            columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))]
            if decoded:
                columns.append(pa.array(bpe.decoded(values, ends), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "token_ids", "decoded"][: 2 + decoded]
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, token_ids array<int>" + ", decoded string" * decoded)


def decode(df: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, token_ids and the text they stand for; null ids decode to an empty text."""

    def run(batches):
        bpe = tokenizer(path)
        for part in common.slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([bpe.decode(i or ()) for i in part.column(1).to_pylist()], pa.string())], names=["doc_id", "token_ids", "decoded"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("token_ids")).mapInArrow(run, "doc_id long, token_ids array<int>, decoded string")


def digests(df: DataFrame) -> DataFrame:
    """The digest columns of encoded and decoded documents."""
    return df.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame, *, memo: int = MEMO) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return digests(encode(docs, path, decoded=True, memo=memo))


# ------------------------------------------------------------------- query
def op5_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents"))
