from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest

from tidewell.llm import common, warc_zip as wz


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("zip64", [False, True])
def test_archive_round_trip(zip64):
    w = wz.ArchiveWriter()
    w.add(1, "http://a/é", "<p>ü</p>\r\n\r\nx".encode(), "response", None)
    w.add(2, None, b"", "response", None)
    w.add(None, "u\r\nv", b"<p>", "revisit", 1)
    data = w.archive(zip64)
    assert zipfile.ZipFile(io.BytesIO(data)).testzip() is None
    r = wz.ArchiveReader(_File(data))
    found = list(r.records())
    assert [p for *_, p in found] == ["<p>ü</p>\r\n\r\nx".encode(), b"", b""]
    assert found[2][1]["WARC-Type"] == "revisit" and found[2][2]["Content-Length"] == "3"
    assert [e["page"] for e, *_ in r.records(r.index()[1:2])] == [2]


def test_zip64_directory():
    """A directory whose end record refers to ZIP64 records."""
    w = wz.ArchiveWriter()
    w.add(1, "u", b"abc", "response", None)
    data = w.archive()
    end = data.rfind(wz.END)
    count = int.from_bytes(data[end + 10 : end + 12], "little")
    length, at = int.from_bytes(data[end + 12 : end + 16], "little"), int.from_bytes(data[end + 16 : end + 20], "little")
    import struct

    end64 = wz.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, at)
    locator = wz.LOCATOR64 + struct.pack("<IQI", 0, end, 1)
    tail = wz.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    r = wz.ArchiveReader(_File(data[:end] + end64 + locator + tail))
    assert [p for *_, p in r.records()] == [b"abc"]


def test_not_an_archive():
    with pytest.raises(ValueError):
        wz.ArchiveReader(_File(b"nothing"))


def run(spark, rows, least=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    got = wz.read_archives(wz.write_archives(pages, common.shared_dir(spark, "w"), least=least)).collect()
    return sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str)


def test_responses_and_revisits(spark):
    rows = [(1, "a", "same", "x"), (2, "b", "same", "x"), (5, "c", "same", "x"), (5, "c", "same", "x"), (3, None, None, "x"), (4, "d", "", "x"), (None, "e", "same", "x"), (6, "f", "é", "x")]
    got = run(spark, rows)
    assert got == sorted([(1, 4, "revisit", 5), (2, 4, "revisit", 5), (5, 4, "response", None), (5, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 4, "revisit", 5), (6, 2, "response", None)], key=str)
    assert {k for _, _, k, _ in run(spark, rows[:3], least=5)} == {"response"}
    assert run(spark, []) == []


def heads(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string")
    for name in [r.archive for r in wz.write_archives(pages, common.shared_dir(spark, "w")).collect()]:
        fs, path = common.filesystem(name)
        with fs.open_input_file(path) as file:
            yield from (head for _, head, _, _ in wz.ArchiveReader(file).records())


def test_record_ids_are_unique_and_referred_to(spark):
    rows = [(k % 6, f"u{k}", "same" if k % 2 else f"p{k // 4}", "x") for k in range(60)]
    for given in (rows, rows * 2):
        found = list(heads(spark, given))
        ids, refers = {h["WARC-Record-ID"] for h in found}, {h["WARC-Refers-To"] for h in found if "WARC-Refers-To" in h}
        assert len(ids) == len(found) == len(given) and len(refers) > 1
        assert refers <= ids or given is not rows


def test_query(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    largest = {}
    for p in pages.values():
        largest[p.html] = max(largest.get(p.html, -1), p.page_id)
    rows = wz.op7_warc_zip(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        payload, top = pages[r.page_id].html.encode(), largest[pages[r.page_id].html]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if top == r.page_id else ("revisit", top))
