"""Scans: catalog and payload by key and time range, the live tail, caller rows, indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CALLER_BOUND, KEYS, Archive


def of(df: DataFrame, source_id: int | None = None, stream: str | None = None) -> DataFrame:
    """Rows of a source and stream; both filters reach the scan."""
    if source_id is not None:
        df = df.where(F.col("source_id") == source_id)
    return df if stream is None else df.where(F.col("stream") == stream)


def streams(segments: DataFrame, wal: DataFrame) -> DataFrame:
    """Streams exist by having a segment or a tail row."""
    return segments.select(*KEYS).union(wal.select(*KEYS)).distinct()


def watermarks(segments: DataFrame) -> DataFrame:
    """source_id, stream, mark: the newest sealed time of each stream."""
    return segments.groupBy(*KEYS).agg(F.max("last_ts").alias("mark"))


def with_mark(wal: DataFrame, segments: DataFrame) -> DataFrame:
    return wal.join(watermarks(segments), KEYS, "left")


def live(wal: DataFrame, segments: DataFrame) -> DataFrame:
    """Tail rows newer than their stream's watermark, or of a stream without segments."""
    return with_mark(wal, segments).where("mark IS NULL OR ts > mark").drop("mark")


def overlapping(segments: DataFrame, start: int, end: int) -> DataFrame:
    """Segments whose span meets [start, end]: whole segments, pruned by the catalog."""
    return segments.where((F.col("last_ts") >= start) & (F.col("first_ts") <= end))


def payload_of(payload: DataFrame, segments: DataFrame) -> DataFrame:
    """The payload of the catalog rows given; on a layout partitioned by the keys this prunes partitions at run time."""
    return payload.join(segments.select(*KEYS, "seq"), [*KEYS, "seq"], "left_semi")


def payload_within(payload: DataFrame, segments: DataFrame) -> DataFrame:
    """payload_of() catalog rows of one time range: their span, two numbers from the catalog, becomes a filter that the payload's scan pushes down."""
    span = segments.agg(F.min("first_ts").alias("first"), F.max("last_ts").alias("last")).first()
    if span.first is None:
        return payload.where("false")
    return payload_of(payload.where(F.col("ts").between(span.first, span.last)), segments)


def indexes(segments: DataFrame, segment_indexes: DataFrame) -> DataFrame:
    """Each segment's caller index, or null; the payload isn't touched."""
    return segments.select(*KEYS, "seq").join(segment_indexes, [*KEYS, "seq"], "left")


def caller_range(caller_rows: DataFrame, start: int, end: int) -> DataFrame:
    return caller_rows.where(F.col("ts").between(start, end))


def caller_asof(caller_rows: DataFrame, upto: int, accepts: Column | None = None) -> DataFrame:
    """For each name the last row at or before upto that `accepts`, by time, then arrival."""
    rows = caller_rows.where(F.col("ts") <= upto)
    rows = rows if accepts is None else rows.where(accepts)
    last = F.max_by(F.struct("ts", "ord", "blob"), F.struct("ts", "ord"))
    return rows.groupBy(*KEYS).agg(last.alias("r")).select(*KEYS, "r.ts", "r.ord", "r.blob")


def asof_join(left: DataFrame, caller_rows: DataFrame, slice_width: int) -> DataFrame:
    """Each left row (keys, ts, ...) with the last caller row of its key at or before it.

    Both sides are laid in one line per key and time slice; the last row that
    each earlier slice ends with, one for each key and slice, serves rows before
    the first caller row of theirs. No key is sorted by one task.
    """
    mine = [c for c in left.columns if c not in (*KEYS, "ts")]
    held = F.struct(F.col("ts").alias("at"), "ord", "blob")
    a = left.select(*KEYS, "ts", F.lit(1).alias("_side"), F.struct(*mine).alias("_row"), F.lit(None).cast("struct<at:bigint,ord:bigint,blob:string>").alias("_held"))
    b = caller_rows.select(*KEYS, "ts", F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), held.alias("_held"))
    line = a.union(b).withColumn("_slice", F.floor(F.col("ts") / slice_width))
    order = [F.col("ts"), F.col("_side"), F.col("_held.ord")]
    own = F.last("_held", ignorenulls=True).over(W.partitionBy(*KEYS, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    ends = line.groupBy(*KEYS, "_slice").agg(F.max("_held").alias("_end"))
    carried = ends.select(*KEYS, "_slice", F.last("_end", ignorenulls=True).over(W.partitionBy(*KEYS).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)).alias("_carried"))
    found = line.withColumn("_own", own).where("_side = 1").join(carried, [*KEYS, "_slice"], "left").withColumn("_found", F.coalesce("_own", "_carried"))
    return found.select(*KEYS, "ts", *[f"_row.{c}" for c in mine], F.col("_found.at").alias("caller_ts"), F.col("_found.ord").alias("caller_ord"), F.col("_found.blob").alias("blob"))


def caller_names(caller_rows: DataFrame) -> DataFrame:
    return caller_rows.select(*KEYS).distinct()


def caller_names_or_bounded(a: Archive) -> DataFrame:
    """Names that hold a row or once did."""
    bounded = a.bounds.where(F.col("kind") == CALLER_BOUND).select("source_id", F.col("name").alias("stream"))
    return a.caller_rows.select(*KEYS).union(bounded).distinct()


def sniff(content: Column, marks: list[tuple[str, int, bytes]]) -> Column:
    """The first kind of (kind, offset, magic) whose magic lies there in a file's bytes, else `other`; null for no bytes at all."""
    out = F.lit("other")
    for kind, offset, magic in reversed(marks):
        out = F.when(F.substring(content, offset + 1, len(magic)) == F.lit(magic), kind).otherwise(out)
    return F.when(F.octet_length(content) > 0, out)
