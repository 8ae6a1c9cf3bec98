"""WARC records in ZIP packages, written in parts and range-read without extraction.

A package holds two stored (uncompressed) members, as web archive collections do:
``archive/data.warc.gz``, one gzip member for each record, and
``indexes/index.cdx``, a line ``page offset length type`` for each record, where
offset and length lie within the archive member. The reader finds the end record,
follows the ZIP64 locator where there is one, parses the central directory, takes
the stored members' places from their local headers, reads the index part by part
and the records block by block. Nothing is unpacked to a file. A task closes a
package when its records reach `package_bytes` and begins the next, so it holds one
package's records at most, and one record more.

Of records with equal payloads of at least 100 bytes the one with the smallest
page_id is a response and the others revisit it: their record names the payload's
digest, its length and the response's page, and carries no payload.

Defined results: a null html is an empty payload; a null page_id never is what
others revisit unless all are null, and then each is a response; rows that repeat
the first page of a payload are responses too, which is the only tie there is; a
payload of any length is one record and digested whole; other columns but url are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, new_path, prepare, slices, written
from .store import create, open_ranges

LEAST_BYTES = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
BLOCK_LINES = 512
BLOCK_BYTES = 4 << 20
PACKAGE_BYTES = 64 << 20  # a package is closed by the record that reaches it

#: Signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
MOST32, MOST16 = 0xFFFFFFFF, 0xFFFF


# --- ZIP ---------------------------------------------------------------------


class StoredZip:
    """Writes stored members to a stream; ZIP64 records are written where `always64` or sizes ask for them."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.members, self.always64 = out, 0, [], always64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, size: int, crc: int, chunks) -> None:
        """A member of known size and CRC-32 from chunks of bytes."""
        place, raw = self.at, name.encode()
        long = self.always64 or size >= MOST32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if long else b""
        short = MOST32 if long else size
        self._write(LOCAL + struct.pack("<5H3I2H", 45 if long else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra)) + raw + extra)
        for chunk in chunks:
            self._write(chunk)
        self.members.append((raw, size, crc, place))

    def close(self) -> None:
        begin = self.at
        for raw, size, crc, place in self.members:
            big, far = self.always64 or size >= MOST32, self.always64 or place >= MOST32
            values = ([size, size] if big else []) + ([place] if far else [])
            extra = struct.pack(f"<HH{len(values)}Q", 1, 8 * len(values), *values) if values else b""
            short = MOST32 if big else size
            self._write(CENTRAL + struct.pack("<6H3I5H2I", 45, 45 if values else 20, 0x800, 0, 0, 33, crc, short, short, len(raw), len(extra), 0, 0, 0, 0, MOST32 if far else place) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.always64 or begin >= MOST32 or size >= MOST32 or n >= MOST16:
            end64 = self.at
            self._write(END64 + struct.pack("<QHHIIQQQQ", END64_SIZE - 12, 45, 45, 0, 0, n, n, size, begin))
            self._write(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
            n, size, begin = MOST16, MOST32, MOST32
        self._write(END + struct.pack("<4H2IH", 0, 0, n, n, size, begin, 0))


@dataclass
class Member:
    name: str
    method: int
    size: int
    crc: int
    header: int  # place of the local header


def directory(file) -> list[Member]:
    """The members of a ZIP file (size(), read_at(n, offset)) from its central directory."""
    total = file.size()
    reach = min(total, END_SIZE + MOST16)  # a comment may follow the end record
    tail = file.read_at(reach, total - reach)
    at = tail.rfind(END)
    while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail) if at + END_SIZE <= len(tail) else at >= 0:
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end record: this is no ZIP file")
    n, size, begin = struct.unpack_from("<HII", tail, at + 10)
    place = total - reach + at
    if (n == MOST16 or size == MOST32 or begin == MOST32) and place >= LOCATOR_SIZE:
        locator = file.read_at(LOCATOR_SIZE, place - LOCATOR_SIZE)
        if locator[:4] == LOCATOR64:
            end64 = file.read_at(END64_SIZE, struct.unpack_from("<Q", locator, 8)[0])
            if end64[:4] != END64:
                raise ValueError("the ZIP64 locator leads nowhere")
            n, size, begin = struct.unpack_from("<QQQ", end64, 32)
    raw, found, at = file.read_at(size, begin), [], 0
    for _ in range(n):
        if raw[at : at + 4] != CENTRAL:
            raise ValueError("the central directory is broken")
        method, = struct.unpack_from("<H", raw, at + 10)
        crc, packed, size = struct.unpack_from("<III", raw, at + 16)
        name_n, extra_n, comment_n = struct.unpack_from("<HHH", raw, at + 28)
        header, = struct.unpack_from("<I", raw, at + 42)
        name = raw[at + 46 : at + 46 + name_n].decode("utf-8", "replace")
        extra, e = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
        while e + 4 <= len(extra):
            kind, length = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # 64-bit values stand for the fields that are full, in this order
                fields = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                size = next(fields) if size == MOST32 else size
                packed = next(fields) if packed == MOST32 else packed
                header = next(fields) if header == MOST32 else header
            e += 4 + length
        found.append(Member(name, method, size, crc, header))
        at += CENTRAL_SIZE + name_n + extra_n + comment_n
    return found


def stored_at(file, member: Member) -> int:
    """Where a stored member's bytes begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: only stored members can be read in ranges")
    head = file.read_at(LOCAL_SIZE, member.header)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    name_n, extra_n = struct.unpack_from("<HH", head, 26)
    return member.header + LOCAL_SIZE + name_n + extra_n


# --- WARC --------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, as a gzip member."""
    kind = "revisit" if revisit else "response"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()), ("X-Payload-Bytes", str(len(payload)))]
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record in its gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _page(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def write_package(out, rows, most_bytes: int | None = None) -> int:
    """rows: an iterator of (page_id, url, payload, refers_to, revisit). Records are taken until they have most_bytes; they are held packed, since their size stands before them."""
    data, lines, at, crc = [], [], 0, 0
    for page_id, url, payload, refers_to, revisit in rows:
        raw = record(page_id, url, payload, refers_to, revisit)
        lines.append(f"{'-' if page_id is None else page_id} {at} {len(raw)} {'revisit' if revisit else 'response'}\n".encode())
        data.append(raw)
        at, crc = at + len(raw), zlib.crc32(raw, crc)
        if most_bytes is not None and at >= most_bytes:
            break
    package, index = StoredZip(out), b"".join(lines)
    package.add(ARCHIVE, at, crc, data)
    package.add(INDEX, len(index), zlib.crc32(index), [index])
    package.close()
    return len(lines)


def index_lines(file, begin: int, size: int):
    """Offset and length of each record, from an index that is read part by part."""
    rest = b""
    for at in range(0, size, BLOCK_BYTES):
        *lines, rest = (rest + file.read_at(min(BLOCK_BYTES, size - at), begin + at)).split(b"\n")
        for line in lines:
            yield tuple(map(int, line.split(b" ")[1:3]))
    if rest:
        yield tuple(map(int, rest.split(b" ")[1:3]))


def read_package(file):
    """Fields and payload of every record, by range reads of a block of records each: BLOCK_LINES at most, and BLOCK_BYTES unless one record is larger."""
    members = {m.name: m for m in directory(file)}
    begin, index = stored_at(file, members[ARCHIVE]), stored_at(file, members[INDEX])
    held: list[tuple[int, int]] = []

    def records():
        if held:
            first = held[0][0]
            block = file.read_at(held[-1][0] + held[-1][1] - first, begin + first)
            for at, n in held:
                yield parse(block[at - first : at - first + n])

    for at, n in index_lines(file, index, members[INDEX].size):
        if held and (len(held) >= BLOCK_LINES or at + n - held[0][0] > BLOCK_BYTES):
            yield from records()
            held = []
        held.append((at, n))
    yield from records()


class Bytes(io.BytesIO):
    """A package in memory, with the reader's two calls."""

    def size(self) -> int:
        return len(self.getbuffer())

    def read_at(self, n: int, offset: int) -> bytes:
        return bytes(self.getbuffer()[offset : offset + n])


# --- Spark -------------------------------------------------------------------


def planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Only digests are shuffled; where the table of repeated payloads is small, payloads stay where they are."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    large = rows.where(F.octet_length("payload") >= LEAST_BYTES).select("page_id", "digest")
    first = written(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "first-pages")
    joined = rows.join(first, "digest", "left")
    own = joined.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    return own.select("page_id", "url", "payload", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit")


def write_packages(pages: DataFrame, folder: str | None = None, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes packages of about package_bytes, one or more for each partition; the table (task, part, path, records) of what was written."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or new_path(spark, "warc")
    schema = pa.schema([("task", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        task, part = TaskContext.get().partitionId(), 0
        rows = (row for batch in slices(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        first = next(rows, None)
        while first is not None:
            path = f"{folder}/part-{task:06d}-{part:04d}.wacz"
            with create(path) as out:
                n = write_package(out, chain([first], rows), package_bytes)
            yield arrow_batch({"task": [task], "part": [part], "path": [path], "records": [n]}, schema)
            first, part = next(rows, None), part + 1

    return written(planned(pages).mapInArrow(run, "task long, part long, path string, records long"), "warc-list")


SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_packages(files: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload). A response's digest is that of the payload as read."""
    prepare(files.sparkSession)
    schema = SCHEMA.append(pa.field("url", pa.string())).append(pa.field("payload", pa.binary())) if with_payload else SCHEMA

    def run(batches):
        rows, held = {name: [] for name in schema.names}, 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with open_ranges(path) as file:
                    for fields, payload in read_package(file):
                        digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Bytes"])
                        if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{path}: the payload of {fields['WARC-Record-ID']} isn't what was written")
                        values = (_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, fields["WARC-Target-URI"], payload)
                        for name, value in zip(schema.names, values, strict=False):
                            rows[name].append(value)
                        held += size if with_payload else 0
                        if len(rows["page_id"]) >= BLOCK_LINES or held >= BLOCK_BYTES:
                            yield arrow_batch(rows, schema)
                            rows, held = {name: [] for name in schema.names}, 0
        yield arrow_batch(rows, schema)

    # A package to a task. Packages are few: a row for each 64 MB of records at least.
    nth = (F.row_number().over(W.orderBy("task", "part")) - 1).cast("int")
    listed = files.select("path", nth.alias("nth")).repartitionById(max(1, files.count()), F.col("nth")).select("path")
    sql = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return listed.mapInArrow(run, sql)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages to packages and reads every record back."""
    return read_packages(write_packages(pages))
