from __future__ import annotations

import hashlib
import io
import random
import struct
import zipfile

import pytest

from tidemark.llm import warc


def package(rows, always64=False):
    out = io.BytesIO()
    if always64:
        data = b"".join(warc.record(*r) for r in rows)
        z = warc.StoredZip(out, True)
        import zlib

        z.add("archive/data.warc.gz", len(data), zlib.crc32(data), [data])
        z.close()
    else:
        warc.write_package(out, iter(rows))
    return warc.Bytes(out.getvalue())


ROWS = [(1, "http://a/1", b"x" * 500, None, False), (2, "http://a/2", b"", None, False), (3, None, b"x" * 500, 1, True), (None, "u", "é\r\n\r\n<p>".encode(), None, False)]


def test_records_round_trip():
    got = [(f["WARC-Type"], payload) for f, payload in warc.read_package(package(ROWS))]
    assert got == [("response", b"x" * 500), ("response", b""), ("revisit", b""), ("response", ROWS[3][2])]


@pytest.mark.parametrize("always64", [False, True])
def test_other_readers_agree_on_the_directory(always64):
    file = package(ROWS, always64)
    with zipfile.ZipFile(io.BytesIO(file.getvalue())) as z:
        assert z.testzip() is None
        for m in warc.directory(file):
            info = z.getinfo(m.name)
            assert (m.size, m.crc, m.header, m.method) == (info.file_size, info.CRC, info.header_offset, 0)
            at = warc.stored_at(file, m)
            assert file.read_at(m.size, at) == z.read(m.name)


def test_comments_and_compressed_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 is no end record here" + b"c" * 300
        z.writestr("stored", b"abc" * 9)
        z.writestr("packed", b"abc" * 900, zipfile.ZIP_DEFLATED)
    file = warc.Bytes(out.getvalue())
    stored, squeezed = warc.directory(file)
    assert file.read_at(stored.size, warc.stored_at(file, stored)) == b"abc" * 9
    with pytest.raises(ValueError, match="compressed"):
        warc.stored_at(file, squeezed)
    with pytest.raises(ValueError, match="no end record"):
        warc.directory(warc.Bytes(b"nothing of the kind" * 9))


def test_archived_pages(spark):
    rng = random.Random(0)
    long = ["<p>" + "".join(rng.choices("abcé ", k=n)) + "</p>" for n in (100, 5000, 200_000)]
    html = [None, "", "short", "short", *long, long[0], long[1], long[1], "é" * 49, "é" * 50, "é" * 50]
    rows = [(i * 7 % 13, f"http://h/{i}", h, i, "x") for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, first long, digest string").repartition(3)
    raw = {p: (h or "").encode() for p, _, h, *_ in rows}
    first = {}
    for p in sorted(raw):
        first.setdefault(raw[p], p)
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert got.keys() == raw.keys()
    for p, data in raw.items():
        again = len(data) >= 100 and first[data] != p
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (got[p].record_type, got[p].refers_to) == (("revisit", first[data]) if again else ("response", None))
    files = warc.write_packages(pages)
    full = {r.page_id: bytes(r.payload) for r in warc.read_packages(files, True).collect() if r.record_type == "response"}
    assert all(full[p] == raw[p] for p in full)


def test_empty_and_null_pages(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archived(pages).count() == 0
    nulls = spark.createDataFrame([(None, None, "n" * 200), (None, None, "n" * 200), (4, None, "n" * 200), (4, None, "n" * 200), (5, "u", "n" * 200)], "page_id long, url string, html string")
    got = sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in warc.archived(nulls).collect())
    assert got == [(-1, "revisit", 4), (-1, "revisit", 4), (4, "response", -1), (4, "response", -1), (5, "revisit", 4)]


def test_signature_sizes():
    assert struct.calcsize("<5H3I2H") + 4 == warc.LOCAL_SIZE and struct.calcsize("<6H3I5H2I") + 4 == warc.CENTRAL_SIZE and struct.calcsize("<4H2IH") + 4 == warc.END_SIZE


def test_packages_are_closed_by_size(spark):
    rng = random.Random(3)
    html = [None if i == 5 else "".join(rng.choices("abcdefghij<>", k=rng.choice([10, 500, 3000]))) for i in range(200)] + ["z" * 5_000_000]
    pages = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").coalesce(2)
    listed = warc.write_packages(pages, package_bytes=20_000)
    assert listed.count() > 8 and listed.agg({"records": "sum"}).first()[0] == len(html)
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_packages(listed, with_payload=True).collect() if r.record_type == "response"}
    assert got == {i: h or "" for i, h in enumerate(html)}


def test_an_index_is_read_in_parts(monkeypatch):
    file = warc.Bytes()
    warc.write_package(file, ((i, "u", b"x" * (i % 300), None, False) for i in range(300)))
    whole = [p for _, p in warc.read_package(file)]
    monkeypatch.setattr(warc, "BLOCK_BYTES", 700)
    assert [p for _, p in warc.read_package(file)] == whole == [b"x" * (i % 300) for i in range(300)]
