"""Packing by power-of-two decomposition: no sequence crosses documents, none needs padding.

A document of n ids gives n div 2048 pieces of 2048 ids and one piece for each
binary digit of the rest, longest first. Each piece is a sequence of its own;
sequences of equal length form a bucket, from which batches are drawn. Sequence
ids number the buckets one after another: tasks number their pieces in each
bucket, and the counts of (task, length) give the base of each run.

Defined results: a null text is the empty text and gives the end id alone;
repeated rows are packed as often as they come; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch, prepare, slices, text_or_empty, written
from .tokens import SLICE_BYTES, SLICE_ROWS, default_path, encoder

LONGEST = 2048
END_ID = 1

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("task", pa.int64()), ("nth", pa.int64())])
PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, nth long"


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """The pieces of a document of n ids; longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece; task and nth place it in its bucket. with_ids adds the ids as array<int>."""
    prepare(docs.sparkSession)
    path = tokenizer or default_path()
    schema = PIECE.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE

    def cut(batches):
        task, seen, encode = TaskContext.get().partitionId(), defaultdict(int), encoder(path).encode
        for batch in slices(batches, SLICE_ROWS, SLICE_BYTES):
            rows = {f.name: [] for f in schema}
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), end_id), strict=True):
                raw, at = memoryview(ids.astype("<u4").tobytes()), 0
                for length in lengths(len(ids), longest):
                    values = (doc, at, length, zlib.crc32(raw[4 * at : 4 * (at + length)]), len(ids), task, seen[length])
                    for name, value in zip(PIECE.names, values, strict=True):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(ids[at : at + length].astype(np.int32))
                    seen[length] += 1
                    at += length
            yield arrow_batch(rows, schema)

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.mapInArrow(cut, PIECE_SQL + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, tokenizer: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids), one row for each piece."""
    cut = written(pieces(docs, tokenizer, longest, end_id, with_ids), "pieces")
    runs = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.orderBy(F.col("length").desc(), "task").rowsBetween(W.unboundedPreceding, -1)
    # A row for each task and length: tasks times 12 at most, whatever the rows. As a table its size is known before
    # the join is planned, so the pieces aren't shuffled for it while it is small.
    base = written(runs.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-bases")
    numbered = cut.join(base, ["length", "task"])
    out = numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids)
    return out
