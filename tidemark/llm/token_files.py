"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus-wide order of frequency, so the
frequent ones take one byte. A block of ids is a header, the control bytes (two
bits an id: its number of bytes less one, four ids a byte) and then the data
bytes, apart, so a numpy table over control bytes gives all positions at once.

A file holds the documents of one range of doc_id in ascending order::

    "TMTOK001"  then blocks, each of whole documents:
      u32 documents, u32 ids, u32 data bytes
      documents x (i64 doc_id, u8 null flag), documents x u32 ids of each
      control bytes, data bytes

The rank table lies beside the files. File k holds no greater doc_ids than file
k+1; the totals of the files before it give a document's place in the whole.

Ranges of doc_id are cut before the texts are tokenized: a sample drawn in
proportion to the texts' bytes is split into equal parts. The key of a row is its
doc_id, the hash of its text and a dealt number, so rows that share one doc_id, or
have none, spread over ranges like any others. Within a range files are cut by
ids, so a file holds `file_ids` and one document more at most, whatever the texts.
The task that tokenizes also counts ids, so each text is read once for its length
and once for its ids.

Defined results: a null text is the empty text and holds the end id alone; a
null doc_id sorts first; rows that share a doc_id stand in the order of their
texts' hashes; ids of equal frequency rank by id; repeated rows are stored as
often as they come; a text of any length is encoded whole and stays in one file;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, new_path, prepare, slices, text_or_empty, written
from .store import create, open_ranges
from .tokens import SLICE_BYTES, SLICE_ROWS, default_path, encoder

MAGIC = b"TMTOK001"
END_ID = 2
BLOCK_IDS = 1 << 18
FILE_IDS = 1 << 25
RANGE_BYTES = 32 << 20  # of text in a range of doc_id
RANGE_SAMPLE = 64  # rows of the sample for each range
SEED = 6

_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)  # of the four ids of a control byte
_RANKS: dict[str, np.ndarray] = {}


def encode_ids(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks (uint32)."""
    raw = ranks.astype("<u4")
    size = 1 + (raw >= 1 << 8).astype(np.uint8) + (raw >= 1 << 16) + (raw >= 1 << 24)
    code = np.zeros(-(-len(raw) // 4) * 4, np.uint8)
    code[: len(raw)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    data = raw.view(np.uint8).reshape(-1, 4)[np.arange(4)[None, :] < size[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ids(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks: a table look-up gives each id's bytes, and their sums its place."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    out = raw[at]
    for k in range(1, 4):
        out |= np.where(size > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return out


@dataclass
class TokenFiles:
    """A written set: its folder, and a table (nth, path, docs, tokens, start) with a row for each file."""

    spark: SparkSession
    folder: str
    files: DataFrame

    def read(self) -> DataFrame:
        """doc_id, start, n_tokens, ids (array<int>)."""
        return self._decoded(True)

    def digests(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32."""
        return self._decoded(False)

    def _decoded(self, with_ids: bool) -> DataFrame:
        table = f"{self.folder}/ranks"
        last = pa.field("ids", pa.list_(pa.int32())) if with_ids else pa.field("ids_crc32", pa.int64())
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), last])

        def run(batches):
            ids_of = _rank_table(table)
            for batch in batches:
                for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for docs, counts, ranks in read_blocks(path):
                        ids = ids_of[ranks]
                        ends = np.cumsum(counts)
                        parts = [ids[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                        found = [p.astype(np.int32) for p in parts] if with_ids else [zlib.crc32(p.tobytes()) for p in parts]
                        yield arrow_batch({"doc_id": docs, "start": start + ends - counts, "n_tokens": counts, last.name: found}, schema)
                        start += int(ends[-1])

        files = self.files.repartitionById(max(1, self.files.count()), F.col("nth")).select("path", "start")
        return files.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids array<int>" if with_ids else "ids_crc32 long"))


def read_blocks(path: str):
    """doc_ids (None: null), ids of each, ranks: block after block, by range reads."""
    with open_ranges(path) as file:
        at, end = len(MAGIC), file.size()
        if file.read_at(at, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        while at < end:
            n_docs, n_ids, n_data = struct.unpack("<III", file.read_at(12, at))
            n_control = -(-n_ids // 4)
            raw = file.read_at(n_docs * 13 + n_control + n_data, at + 12)
            doc = np.frombuffer(raw, "<i8", n_docs)
            null = np.frombuffer(raw, np.uint8, n_docs, 8 * n_docs)
            counts = np.frombuffer(raw, "<u4", n_docs, 9 * n_docs).astype(np.int64)
            control, data = raw[13 * n_docs : 13 * n_docs + n_control], raw[13 * n_docs + n_control :]
            yield [None if z else d for d, z in zip(doc.tolist(), null.tolist(), strict=True)], counts, decode_ids(control, data, n_ids)
            at += 12 + len(raw)


def _rank_table(path: str) -> np.ndarray:
    """The id of each rank."""
    if path not in _RANKS:
        _RANKS.clear()
        with open_ranges(path) as file:
            _RANKS[path] = np.frombuffer(file.read_at(file.size(), 0), "<u4")
    return _RANKS[path]


def _packer():
    """Packs ids for the working table: their byte planes, 2 where that is enough, by a fast compressor."""
    compress = zstandard.ZstdCompressor(level=1).compress

    def pack(ids: np.ndarray) -> bytes:
        width = 2 if ids.max(initial=0) < 1 << 16 else 4
        return bytes([width]) + compress(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes())

    return pack


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(zstandard.decompress(memoryview(packed)[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").reshape(-1).astype(np.uint32, copy=False)


def _block(docs: list, parts: list[np.ndarray], rank_of: np.ndarray) -> bytes:
    counts = np.array([len(p) for p in parts], "<u4")
    control, data = encode_ids(rank_of[np.concatenate(parts)])
    doc = np.array([0 if d is None else d for d in docs], "<i8")
    null = np.array([d is None for d in docs], np.uint8)
    return b"".join([struct.pack("<III", len(docs), int(counts.sum()), len(data)), doc.tobytes(), null.tobytes(), counts.tobytes(), control, data])


def _keyed(docs: DataFrame) -> DataFrame:
    """text, and the key that orders rows: has_id, doc_id, tie, deal."""
    text = text_or_empty()
    deal = (F.rand(SEED) * (1 << 30)).cast("long")
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("tie"), deal.alias("deal"))


def range_bounds(keyed: DataFrame, range_bytes: int = RANGE_BYTES) -> list[tuple[bool, int, int, int]]:
    """The least key of each range but the first; a key is (has an id, doc_id, tie, deal). A row for each range reaches the driver."""
    size = keyed.select("doc_id", "tie", "deal", F.octet_length("text").cast("long").alias("bytes"))
    total = size.agg(F.sum("bytes")).first()[0] or 0
    ranges = -(-total // range_bytes)
    if ranges <= 1:
        return []
    unit = range_bytes / RANGE_SAMPLE
    drawn = F.floor(F.col("bytes") / unit + F.rand(SEED + 1)).cast("int")
    keys = [F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "tie", "deal"]
    sample = written(size.where(drawn > 0).select(*keys, drawn.alias("times")), "range-sample")
    sample = sample.withColumn("_", F.explode(F.sequence(F.lit(1), "times")))
    key = F.struct("has_id", "doc_id", "tie", "deal")
    cut = sample.repartitionByRange(int(ranges), "has_id", "doc_id", "tie", "deal").groupBy(F.spark_partition_id()).agg(F.min(key).alias("key"))
    return sorted(tuple(r.key) for r in cut.collect())[1:]


def write_token_files(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, range_bytes: int = RANGE_BYTES, file_ids: int = FILE_IDS) -> TokenFiles:
    """Encodes docs (doc_id, text) and writes the files; each text is tokenized once, into a table of packed ids."""
    spark = docs.sparkSession
    prepare(spark)
    folder, vocabulary = folder or new_path(spark, "token-files"), tokenizer or default_path()
    keyed = _keyed(docs)
    bounds = range_bounds(keyed, range_bytes)

    def tokenize(batches):
        encode, pack, sums = encoder(vocabulary).encode, _packer(), np.zeros(0, np.int64)
        schema = pa.schema([("file", pa.int32()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary()), ("id", pa.int64()), ("n", pa.int64())])
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES):
            parts = encode(batch.column(1), end_id)
            keys = zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True)
            files = [bisect_right(bounds, (doc is not None, doc or 0, tie, deal)) for doc, tie, deal in keys]
            found = np.bincount(np.concatenate(parts), minlength=len(sums))
            found[: len(sums)] += sums
            sums, none = found, [None] * len(parts)
            yield arrow_batch({"file": files, "doc_id": batch.column(0), "tie": batch.column(2), "packed": [pack(p) for p in parts], "id": none, "n": none}, schema)
        at = np.nonzero(sums)[0]
        none = [None] * len(at)
        yield arrow_batch({"file": none, "doc_id": none, "tie": none, "packed": none, "id": at, "n": sums[at]}, schema)

    tokens = written(keyed.mapInArrow(tokenize, "file int, doc_id long, tie long, packed binary, id long, n long"), "token-ids", compression="none")
    # A row for each id of the vocabulary at most.
    counted = tokens.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toArrow()
    id_of = counted.column("id").to_numpy().astype("<u4")
    with create(f"{folder}/ranks") as out:
        out.write(id_of.tobytes())

    def encode(batches):
        file, nth = TaskContext.get().partitionId(), 0
        id_of = _rank_table(f"{folder}/ranks")
        rank_of = np.zeros(int(id_of.max()) + 1 if len(id_of) else 1, np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        rows = ((doc, unpack(packed)) for batch in slices(batches) for doc, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        row = next(rows, None)
        while row is not None:
            path, n_docs, n_ids = f"{folder}/part-{file:06d}-{nth:04d}", 0, 0
            with create(path) as out:
                out.write(MAGIC)
                while row is not None and n_ids < file_ids:
                    held, docs, parts = 0, [], []
                    while row is not None and held < BLOCK_IDS:
                        docs.append(row[0])
                        parts.append(row[1])
                        held += len(row[1])
                        row = next(rows, None)
                    out.write(_block(docs, parts, rank_of))
                    n_docs, n_ids = n_docs + len(docs), n_ids + held
            yield arrow_batch({"file": [file], "part": [nth], "path": [path], "docs": [n_docs], "tokens": [n_ids]}, pa.schema([("file", pa.int64()), ("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))
            nth += 1

    ordered = tokens.where("packed IS NOT NULL").repartitionById(len(bounds) + 1, F.col("file")).select("doc_id", "tie", "packed").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie").select("doc_id", "packed")
    files = written(ordered.mapInArrow(encode, "file long, part long, path string, docs long, tokens long"), "token-file-list")
    # A row for each file: their running total is small whatever the input.
    line = W.orderBy("file", "part")
    nth = (F.row_number().over(line) - 1).cast("int")
    start = F.coalesce(F.sum("tokens").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return TokenFiles(spark, folder, written(files.select(nth.alias("nth"), "path", "docs", "tokens", start.alias("start")), "token-file-starts"))
