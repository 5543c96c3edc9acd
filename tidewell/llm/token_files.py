"""Token ids as seekable binary files.

A shard is a run of independent zstandard frames, one a document, and after
them a skippable frame with the document ids and a seek table in the public
zstd seekable format: for each frame its compressed and plain size and the low
32 bits of the XXH64 of its plain bytes. A reader opens the table from the
file's end and decompresses the frames it wants and no others.

Defined results: a null text is an empty one; an empty text has the end id
alone; rows that repeat a document id are written once each, in the order of
their text's hash; a null id sorts first; an empty table gives no shard and no
row; other columns are not read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

# Fixed values of the zstd seekable format.
SKIPPABLE_IDS = 0x184D2A50
SKIPPABLE_TABLE = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

#: Words that a worker remembers, about 0.2 kB each.
MEMO = 800_000
#: A word of composed Latin letters; marks at a word's end; words of marks alone.
LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
MARKS_END = "([a-z\u00df-\u00f6\u00f8-\u00ff])([!-/:-@\\[-`{-~]+)( |$)"
ONLY_MARKS = re.compile("[!-/:-@\\[-`{-~]+")

_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


# --------------------------------------------------------------- the format
class ShardWriter:
    """Writes one shard to a binary stream."""

    def __init__(self, out, dtype: str = "<u2", level: int = 3):
        self.out, self.dtype = out, np.dtype(dtype)
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []

    def add(self, doc_id: int | None, tokens: bytes) -> None:
        """``tokens``: the ids in the shard's dtype."""
        frame = self.packer.compress(tokens)
        self.out.write(frame)
        self.frames.append((len(frame), len(tokens), xxhash.xxh64_intdigest(tokens) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        null = np.array([i is None for i in self.ids], "u1").tobytes()
        ids = np.array([i or 0 for i in self.ids], "<i8").tobytes()
        body = self.dtype.str.encode().ljust(8) + self.packer.compress(ids + null)
        self.out.write(struct.pack("<II", SKIPPABLE_IDS, len(body)) + body)
        table = np.array([*self.frames, (len(body) + 8, 0, 0)], _ENTRY).tobytes()
        footer = struct.pack("<IBI", len(self.frames) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(table) + len(footer)) + table + footer)
        self.out.close()


class ShardReader:
    """Reads documents of a shard by their place, from a random-access file."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable token shard")
        start = size - 9 - count * _ENTRY.itemsize
        mark, length = struct.unpack("<II", self._at(start - 8, 8))
        if mark != SKIPPABLE_TABLE or length != size - start:
            raise ValueError("the seek table is damaged")
        self.table = np.frombuffer(self._at(start, size - 9 - start), _ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.table["packed"], dtype=np.int64)])
        self.plain = zstandard.ZstdDecompressor()
        body = self._at(int(self.offsets[-2]) + 8, int(self.table["packed"][-1]) - 8)
        self.dtype = np.dtype(body[:8].decode().strip())
        n, ids = count - 1, self.plain.decompress(body[8:])
        null = np.frombuffer(ids, "u1", n, n * 8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(ids, "<i8", n), null, strict=True)]

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def counts(self) -> np.ndarray:
        """Ids of each document, from the seek table alone."""
        return self.table["plain"][:-1].astype(np.int64) // self.dtype.itemsize

    def _checked(self, k: int, frame: bytes) -> np.ndarray:
        plain = self.plain.decompress(frame, max_output_size=int(self.table["plain"][k])) if self.table["plain"][k] else b""
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["sum"][k]:
            raise ValueError(f"frame {k}: wrong checksum")
        return np.frombuffer(plain, self.dtype)

    def tokens(self, k: int) -> np.ndarray:
        """The ids of the document at place ``k``; only its frame is read."""
        return self._checked(k, self._at(int(self.offsets[k]), int(self.table["packed"][k])))

    def run(self, first: int, last: int) -> Iterator[np.ndarray]:
        """Documents ``first`` to ``last`` (exclusive), with one read."""
        data = memoryview(self._at(int(self.offsets[first]), int(self.offsets[last] - self.offsets[first])))
        for k in range(first, last):
            at = int(self.offsets[k] - self.offsets[first])
            yield self._checked(k, bytes(data[at : at + int(self.table["packed"][k])]))


# ---------------------------------------------------------------- encoding
class WordEncoder:
    """Ids of whole texts from a ``tokenizers`` file, by a memo over words.

    The file's normaliser and its splitting never join characters across a
    blank or line feed, so a text's ids are those of its words in order; the
    library encodes every word that the memo lacks. Texts of composed Latin
    letters are put in small letters first, and marks at the ends of words
    apart, where neither changes an id.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memo = common.Cache(MEMO)
        mark = self._ids(self.MARK)
        end = self.library.model.end_of_word_suffix
        self.last = None
        if end:
            self.last = np.zeros(self.library.get_vocab_size(), bool)
            self.last[[i for t, i in self.library.get_vocab().items() if t.endswith(end)]] = True
        #: Whether capitals have the ids of small letters, and the strings that are looked for before anything else.
        self.tell = self._ids("\u00c9Ab") == self._ids("\u00e9ab")
        self.apart = True
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.mark = mark[0] if len(mark) == 1 and self._ids(f"a {self.MARK} a") == [*self._ids("a"), *mark, *self._ids("a")] else None

    #: A control character that stands between words when many are encoded in one call.
    MARK = "\x01"

    def _ids(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, words: list[str]) -> None:
        self.apart = self.apart and (not self.tell or all(self._splits(w) for w in words if ONLY_MARKS.fullmatch(w)))
        if self.last is not None:
            # a word of Latin letters is one pre-token, whose last id, and no other, ends a word
            letters = [w for w in words if LETTERS.fullmatch(w)]
            ids = np.array(self._ids(" ".join(letters)), self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize
            if len(ends) == len(letters):
                blob, at = ids.tobytes(), 0
                for w, end in zip(letters, ends.tolist(), strict=True):
                    self.memo[w] = blob[at:end]
                    at = end
                words = [w for w in words if w not in self.memo]
        apart = [w for w in words if self.mark is None or self.MARK in w]
        for w, e in zip(apart, self.library.encode_batch_fast(apart, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, self.dtype).tobytes()
        if together := [w for w in words if w not in self.memo]:
            ids = np.array(self._ids(f" {self.MARK} ".join(together)), self.dtype)
            blob, width, at = ids.tobytes(), self.dtype.itemsize, 0
            for w, end in zip(together, [*(np.flatnonzero(ids == self.mark) * width).tolist(), len(blob)], strict=True):
                self.memo[w] = blob[at:end]
                at = end + width

    def _folded(self, text: str) -> str:
        """The text in small letters where that changes no id: in Latin-1 letters are composed and have one small form each."""
        if self.tell:
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text
            low = text.lower()
            if not any(x in low for x in self.special):
                return low
        return text

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text: its distinct words are looked up, or learnt, and then taken in the texts' order."""
        whole = {k: np.array(self._ids(t), self.dtype).tobytes() for k, t in enumerate(texts) if any(x in t for x in self.special)}
        rows = pc.replace_substring(pa.array(["" if k in whole else self._folded(t) for k, t in enumerate(texts)], pa.string()), "\n", " ")
        words = pc.split_pattern(pc.replace_substring_regex(rows, MARKS_END, r"\1 \2\3") if self.tell else rows, " ")
        ids, ends = common.gathered(words, lambda distinct: self.memo.asked(distinct, self._learn), pa.binary())
        if not self.apart:
            self.tell, self.apart = False, True  # marks that the file doesn't split from letters: words stay as they are
            self.memo.clear()
            return self.encode(texts)
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ends + ids.offset].tolist()
        data = memoryview(ids.buffers()[2] or b"")
        return [whole.get(k) or bytes(data[x:y]) for k, (x, y) in enumerate(zip(ends, ends[1:], strict=False))]

    def _splits(self, marks: str) -> bool:
        """Whether the file splits these marks from letters before them."""
        return self._ids(f"abc{marks}") == [*self._ids("abc"), *self._ids(marks)]


@functools.lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoder(path: str) -> WordEncoder:
    found = _encoder(path)
    common.sole(found.memo)
    return found


# --------------------------------------------------------------- operators
def write_shards(docs: DataFrame, tokenizer: str, to: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, level: int = 3, mb: int = 48) -> DataFrame:
    """Encode, order by id and write; returns the manifest, a row a shard, in file order.

    Texts are range-partitioned by id before encoding, so that sampling the
    bounds encodes nothing; ties on an id are spread by the text's hash. A task
    writes to a name of its own and renames at the end: a repeated or
    speculative task leaves no half shard, and the manifest names whole ones.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(common.partitions(rows, mb), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        make, shard, n, total = encoder(tokenizer), None, 0, 0
        end = np.array([end_id], make.dtype).tobytes()
        first = None
        for part in common.slices(batches):
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            if shard is None:
                fs, root = common.filesystem(to)
                fs.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.tok.zst"
                shard = ShardWriter(fs.open_output_stream(f"{root}/.{name}", compression=None), make.dtype.str, level)
                first = (ids[0], part.column(2)[0].as_py())
            for i, tokens in zip(ids, make.encode(texts), strict=True):
                shard.add(i, tokens + end)
                n, total = n + 1, total + len(tokens) // make.dtype.itemsize + 1
        if shard is not None:
            shard.close()
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"shard": [f"{to}/{name}"], "first_id": pa.array([first[0]], pa.int64()), "first_tie": [first[1]], "n_docs": [n], "n_ids": [total]})

    found = ordered.mapInArrow(run, "shard string, first_id long, first_tie long, n_docs long, n_ids long")
    return common.written(found, "token-manifest")


def read_shards(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, tokens: ids as little-endian unsigned 32-bit) from the shards.

    The manifest has a row a shard, so that ordering it and adding up what
    shards before hold takes the driver a list as long as the files are many.
    ``wanted`` decompresses the frames of those documents only.
    """
    spark = manifest.sparkSession
    rows = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_tie))
    starts, at = [], 0
    for r in rows:
        starts.append((r.shard, at))
        at += r.n_ids
    wish = None if wanted is None else set(wanted)

    def run(batches):
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = common.filesystem(shard)
                with fs.open_input_file(path) as file:
                    reader = ShardReader(file)
                    counts = reader.counts()
                    begin = base + np.concatenate([[0], np.cumsum(counts)])
                    for lo in range(0, len(reader), 512):
                        hi = min(lo + 512, len(reader))
                        keep = [k for k in range(lo, hi) if wish is None or reader.doc_ids[k] in wish]
                        got = reader.run(lo, hi) if wish is None else (reader.tokens(k) for k in keep)
                        if keep:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array([reader.doc_ids[k] for k in keep], pa.int64()), pa.array(begin[keep], pa.int64()), pa.array(counts[keep], pa.int64()), pa.array([g.astype("<u4").tobytes() for g in got], pa.binary())],
                                names=["doc_id", "start", "n_tokens", "tokens"],
                            )

    todo = spark.createDataFrame(starts, "shard string, base long").repartition(max(1, len(starts)))
    return todo.mapInArrow(run, "doc_id long, start long, n_tokens long, tokens binary")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("tokens").alias("ids_crc32"))


def crc32_of(ids) -> int:
    """The digest of one document's ids, for readers without Spark."""
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


# ------------------------------------------------------------------- query
def op1_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_shards(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), common.shared_dir(spark, "token-shards"))
    return digests(read_shards(manifest))
