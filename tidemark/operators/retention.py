"""Retention: eviction before a cutoff, with floors, bounds and a report; deleting live or tail rows.

Every function judges what is live against the archive it is given, before
anything goes, and returns a new archive; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import CALLER_BOUND, KEYS, STREAM_BOUND, Archive
from .ingest import as_bounds, raise_bounds
from .scan import with_mark


def alive() -> Column:
    """A tail row joined with its stream's watermark is live."""
    return F.col("mark").isNull() | (F.col("ts") > F.col("mark"))


@dataclass(frozen=True)
class Evicted:
    archive: Archive
    report: DataFrame  # segments, wal_rows, kept_live_rows, caller_rows


def _tops(a: Archive, scope: Column) -> DataFrame:
    """keys, ts: the newest row that each stream in scope holds."""
    held = a.wal.select(*KEYS, "ts").union(a.segments.select(*KEYS, F.col("last_ts").alias("ts"))).where(scope)
    return held.groupBy(*KEYS).agg(F.max("ts").alias("ts"))


def _oldest(segments: DataFrame, wal: DataFrame, keys: list[str]) -> DataFrame:
    every = segments.select(*KEYS, F.col("first_ts").alias("ts")).union(wal.select(*KEYS, "ts"))
    return every.groupBy(*keys).agg(F.min("ts").alias("oldest"))


def evict(a: Archive, source_id: int, cutoff: int, streams: Column | None = None, floor: Column | None = None) -> Evicted:
    """Deletes what lies before cutoff: covered tail rows, whole segments, clock observations, caller rows.

    streams: a condition on `stream`; clock observations then go below the
    source's oldest surviving row instead. floor: for a caller-row name the time
    below which its rows may go, from `stream` and `oldest`, its oldest surviving
    stream row; rows go below the lesser of it and cutoff. Live rows never go.
    """
    mine = F.col("source_id") == source_id
    scope = mine if streams is None else mine & streams
    old = F.col("ts") < cutoff
    marked = with_mark(a.wal, a.segments)
    gone_row, gone_segment = scope & old & ~alive(), scope & (F.col("last_ts") < cutoff)
    wal = marked.where(~gone_row).drop("mark")
    segments = a.segments.where(~gone_segment)
    bounds = raise_bounds(a.bounds, as_bounds(_tops(a, scope).where(old), STREAM_BOUND))

    if floor is None:
        cut = a.caller_rows.withColumn("_cut", F.lit(cutoff))
    else:
        oldest = _oldest(segments, wal, KEYS)
        cut = a.caller_rows.join(oldest, KEYS, "left").withColumn("_cut", F.least(floor, F.lit(cutoff))).drop("oldest")
    gone_caller = scope & (F.col("ts") < F.col("_cut"))
    tops = cut.where(scope).groupBy(*KEYS).agg(F.max("ts").alias("ts"), F.first("_cut").alias("_cut")).where("ts < _cut").select(*KEYS, "ts")
    bounds = raise_bounds(bounds, as_bounds(tops, CALLER_BOUND))

    if streams is None:
        clock = a.clock_offsets.where(~(mine & old))
    else:
        first = _oldest(segments, wal, ["source_id"])
        clock = a.clock_offsets.join(first, "source_id", "left").where(~(mine & (F.col("ts") < F.coalesce("oldest", F.lit(cutoff))))).drop("oldest")

    count = lambda df, **kinds: df.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    report = (
        count(a.segments, segments=gone_segment)
        .crossJoin(count(marked, wal_rows=gone_row, kept_live_rows=scope & old & alive()))  # one row each
        .crossJoin(count(cut, caller_rows=gone_caller))
    )
    kept_keys = segments.select(*KEYS, "seq")
    out = replace(
        a, segments=segments, wal=wal, bounds=bounds, clock_offsets=clock, caller_rows=cut.where(~gone_caller).drop("_cut"),
        payload=a.payload.join(kept_keys, [*KEYS, "seq"], "left_semi"), segment_indexes=a.segment_indexes.join(kept_keys, [*KEYS, "seq"], "left_semi"),
    )
    return Evicted(out, report)


def discard_live(a: Archive, scope: Column) -> Archive:
    """Deletes live rows alone, after their streams' newest rows are recorded as bounds."""
    marked = with_mark(a.wal, a.segments)
    touched = marked.where(scope & alive()).select(*KEYS).distinct()
    tops = _tops(a, F.lit(True)).join(touched, KEYS, "left_semi")
    return replace(a, wal=marked.where(~(scope & alive())).drop("mark"), bounds=raise_bounds(a.bounds, as_bounds(tops, STREAM_BOUND)))


def prune(a: Archive, source_id: int, stream: str, upto: int) -> Archive:
    """Deletes a stream's tail rows up to a time; a bound is recorded only where that passes its watermark."""
    mine = (F.col("source_id") == source_id) & (F.col("stream") == stream)
    marked = with_mark(a.wal.where(mine), a.segments)
    gone = marked.where(F.col("ts") <= upto).groupBy(*KEYS).agg(F.max("ts").alias("ts"), F.first("mark").alias("mark")).where("mark IS NULL OR ts > mark").select(*KEYS, "ts")
    return replace(a, wal=a.wal.where(~(mine & (F.col("ts") <= upto))), bounds=raise_bounds(a.bounds, as_bounds(gone, STREAM_BOUND)))


def delete_segments(a: Archive, gone: DataFrame) -> Archive:
    """Without the segments named (keys, seq); their caller indexes go with them."""
    k = [*KEYS, "seq"]
    return replace(a, segments=a.segments.join(gone, k, "left_anti"), payload=a.payload.join(gone, k, "left_anti"), segment_indexes=a.segment_indexes.join(gone, k, "left_anti"))


def delete_tail(a: Archive, source_id: int, stream: str, after: int | None = None, upto: int | None = None) -> Archive:
    """Without a stream's tail rows in (after, upto]."""
    hit = (F.col("source_id") == source_id) & (F.col("stream") == stream)
    hit = hit if after is None else hit & (F.col("ts") > after)
    hit = hit if upto is None else hit & (F.col("ts") <= upto)
    return replace(a, wal=a.wal.where(~hit))
