"""Web archives packaged as ZIP files, written and read back.

An archive is a ZIP file whose members are stored, not compressed: a WARC file
whose records are gzip members of their own, and an index with a line a record.
The reader parses the central directory (with ZIP64 records where sizes or
counts need them), finds the stored index and WARC members, and reads single
records by range; it extracts no member.

Only payloads that occur several times are dealt by digest, each over ``SALTS``
tasks; all others are written where they lie. Of records with equal payloads the
one with the largest page id is the response; the others are revisit records of the identical-payload-digest
profile that keep the HTTP head and refer to it. Payloads shorter than
``least`` bytes are all responses.

Defined results: a null html is an empty payload; rows that repeat a page id
and a payload are responses each where that id is the largest, and have record
ids of their own, so that what refers to them names their page and payload; a null id never
is the largest unless all are; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm import common

#: A repeated payload's rows go to so many tasks.
SALTS = 32
#: Payloads of more rows than this are dealt so.
SALTED = 1_000
#: Archives are closed at about so many bytes.
ARCHIVE_MB = 24
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
# Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, said: str, own: str = "") -> str:
    """A record's id, by its page, payload and address, and a mark of its ``own`` where those may occur again."""
    mark = "" if url is None else f"{zlib.crc32(url.encode()):08x}"
    return f"<urn:page:{'null' if page_id is None else page_id}:{said}:{mark}{own and ':'}{own}>"


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None, refers_url: str | None = None, own: str = "") -> bytes:
    """One WARC record, not compressed."""
    said = digest(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, url, said, own)}",
        f"WARC-Target-URI: {target}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{said}",
        "Content-Type: application/http; msgtype=response",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, refers_url, said)}"] if kind == "revisit" else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


# ----------------------------------------------------------------- archives
class ArchiveWriter:
    """Gathers records up to a bounded size and gives the archive's bytes."""

    def __init__(self):
        self.data, self.lines = io.BytesIO(), []

    @property
    def size(self) -> int:
        return self.data.tell()

    def add(self, page_id, url, payload: bytes, kind: str, refers, refers_url=None, own: str = "") -> None:
        at = self.data.tell()
        self.data.write(gzip.compress(record(page_id, url, payload, kind, refers, refers_url, own), 4, mtime=0))
        self.lines.append(json.dumps({"page": page_id, "offset": at, "length": self.data.tell() - at, "type": kind}))

    def archive(self, zip64: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, body in ((DATA, self.data.getbuffer()), (INDEX, "\n".join(self.lines).encode())):
                with z.open(zipfile.ZipInfo(name), "w", force_zip64=zip64) as f:
                    f.write(body)
        return out.getvalue()


class ArchiveReader:
    """Reads records by range from a random-access file with ``seek``, ``read`` and ``size``."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        self.members = self._directory()

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _directory(self) -> dict[str, tuple[int, int]]:
        """Members: name to (offset of the local header, size)."""
        tail_at = max(0, self.size - 65557)  # the end record and the longest comment
        tail = self.read(tail_at, self.size - tail_at)
        end = tail.rfind(END)
        if end < 0:
            raise ValueError("not a ZIP archive")
        count, length, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        if count == 0xFFFF or length == 0xFFFFFFFF or at == 0xFFFFFFFF or tail[end - 20 : end - 16] == LOCATOR64:
            if tail[end - 20 : end - 16] == LOCATOR64:
                (at64,) = struct.unpack("<Q", tail[end - 12 : end - 4])
                record64 = self.read(at64, 56)
                if record64[:4] != END64:
                    raise ValueError("the ZIP64 end record is damaged")
                count, length, at = struct.unpack("<QQQ", record64[32:56])
        raw, p, found = self.read(at, length), 0, {}
        for _ in range(count):
            if raw[p : p + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            (method,) = struct.unpack("<H", raw[p + 10 : p + 12])
            packed, plain, n, m, k = struct.unpack("<IIHHH", raw[p + 20 : p + 34])
            (offset,) = struct.unpack("<I", raw[p + 42 : p + 46])
            name, extra = raw[p + 46 : p + 46 + n].decode(), raw[p + 46 + n : p + 46 + n + m]
            while len(extra) >= 4:
                tag, size = struct.unpack("<HH", extra[:4])
                if tag == 1:  # ZIP64: those of the fields that are at their limits, in this order
                    wide = iter(struct.unpack(f"<{size // 8}Q", extra[4 : 4 + size // 8 * 8]))
                    plain = next(wide) if plain == 0xFFFFFFFF else plain
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    offset = next(wide) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + size :]
            if method:
                raise ValueError(f"{name} is compressed")
            found[name] = (offset, packed)
            p += 46 + n + m + k
        return found

    def span(self, name: str) -> tuple[int, int]:
        """Where a member's bytes lie."""
        offset, size = self.members[name]
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("a local header is damaged")
        n, m = struct.unpack("<HH", head[26:30])
        return offset + 30 + n + m, size

    def index(self) -> list[dict]:
        at, n = self.span(INDEX)
        return [json.loads(x) for x in self.read(at, n).decode().split("\n") if x]

    def records(self, entries: list[dict] | None = None) -> Iterator[tuple[dict, dict[str, str], dict[str, str], bytes]]:
        """The records of index entries (all, if None), each by a read of its range."""
        start, _ = self.span(DATA)
        for e in self.index() if entries is None else entries:
            yield e, *parse(gzip.decompress(self.read(start + e["offset"], e["length"])))


# --------------------------------------------------------------- operators
def write_archives(pages: DataFrame, to: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Write the pages' records; returns the archives' names.

    Which record is the response comes from an aggregate over digests, so that
    many copies of one payload are counted before anything is shuffled; only
    rows of digests with several rows are shuffled and joined back.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html")))
    alike = rows.groupBy("sha", "page", "url").agg(F.count("*").alias("n"))
    best = alike.groupBy("sha").agg(F.max(F.struct("page", "url", "n")).alias("best"), F.sum("n").alias("n")).where("n > 1").select("sha", "best", "n")
    best = common.written(best, "repeated")
    # a payload that the bit map lets by is joined with nothing
    once = common.marked(rows, F.col("sha"), best.select("sha"), other=True).select("page", "url", "html", F.lit(None).cast("struct<page:long,url:string,n:long>").alias("best"))
    again = common.marked(rows, F.col("sha"), best.select("sha"))
    # payloads of many rows are dealt over many tasks; the same bit map tells on both sides which those may be
    many, zero = best.where(F.col("n") > SALTED).select("sha"), F.lit(0).cast("long")
    split = lambda df, salt: common.marked(df, F.col("sha"), many).withColumn("salt", salt).unionByName(common.marked(df, F.col("sha"), many, other=True).withColumn("salt", zero))
    again = split(again, F.pmod(F.xxhash64("page", "url"), F.lit(SALTS)))
    best = split(best.select("sha", "best"), F.explode(F.sequence(zero, F.lit(SALTS - 1).cast("long"))))
    todo = once.unionByName(again.join(best, ["sha", "salt"], "left").select("page", "url", "html", "best"))

    def run(batches):
        fs = root = None
        writer, names = ArchiveWriter(), []

        def flush():
            nonlocal writer
            name = f"{uuid.uuid4().hex}.wacz"
            with fs.open_output_stream(f"{root}/.{name}", compression=None) as out:
                out.write(writer.archive())
            fs.move(f"{root}/.{name}", f"{root}/{name}")
            names.append(f"{to}/{name}")
            writer = ArchiveWriter()

        for part in common.slices(batches):
            if fs is None:
                fs, root = common.filesystem(to)
                fs.create_dir(root, recursive=True)
            for page, url, html, top in zip(*(c.to_pylist() for c in part.columns), strict=True):
                payload = html.encode()
                again = top is not None and page != top["page"] and len(payload) >= least
                # a response that others refer to has a plain id, if it is one row
                plain = top is None or (page, url, 1) == (top["page"], top["url"], top["n"])
                writer.add(page, url, payload, "revisit" if again else "response", *((top["page"], top["url"]) if again else (None, None)), "" if plain else uuid.uuid4().hex)
                if writer.size > ARCHIVE_MB << 20:
                    flush()
        if writer.lines:
            flush()
        yield pa.RecordBatch.from_pydict({"archive": pa.array(names, pa.string())})

    return common.written(todo.mapInArrow(run, "archive string"), "warc-manifest")


def read_archives(archives: DataFrame) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives' records."""
    number = lambda x: None if x is None or (n := x[len("<urn:page:") : -1].split(":")[0]) == "null" else int(n)

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = common.filesystem(name)
                with fs.open_input_file(path) as file:
                    rows = []
                    for _, head, http, payload in ArchiveReader(file).records():
                        kind, said = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (digest(payload) != said or len(payload) != int(http["Content-Length"])):
                            raise ValueError(f"{name}: a payload is damaged")
                        rows.append((number(head["WARC-Record-ID"]), int(http["Content-Length"]), said, kind, number(head.get("WARC-Refers-To"))))
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    many = archives.sparkSession.sparkContext.defaultParallelism * 4
    return archives.repartition(many).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


# ------------------------------------------------------------------- query
def op7_warc_zip(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(common.table(spark, sf_dir, "pages"), common.shared_dir(spark, "warc")))
