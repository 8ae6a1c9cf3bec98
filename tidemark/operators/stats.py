"""Aggregates over the catalog and the tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CALLER_BOUND, KEYS, STOPPED_AFTER_INTERVALS, STREAM_BOUND, Archive
from .scan import live


def sealed_spans(segments: DataFrame) -> DataFrame:
    """source_id, stream, n_segments, n_rows, first_ts, last_ts, n_bytes."""
    return segments.groupBy(*KEYS).agg(
        F.count("*").alias("n_segments"), F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_bytes").alias("n_bytes"),
    )


def live_spans(a: Archive) -> DataFrame:
    return live(a.wal, a.segments).groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def size_cut(segments: DataFrame, most_bytes: int, slice_width: int) -> DataFrame:
    """For each source the newest last_ts that has to go so that the rest fits in most_bytes; sources that fit have none.

    Bytes are summed by time slice first, so a source's segments aren't sorted by one task.
    """
    sliced = segments.withColumn("_slice", F.floor(F.col("last_ts") / slice_width))
    sums = sliced.groupBy("source_id", "_slice").agg(F.sum("n_bytes").alias("_b"))
    later = F.coalesce(F.sum("_b").over(W.partitionBy("source_id").orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    newer = sums.select("source_id", "_slice", later.alias("_later"))
    within = F.sum("n_bytes").over(W.partitionBy("source_id", "_slice").orderBy(F.desc("last_ts")).rangeBetween(W.unboundedPreceding, 0))
    total = sliced.withColumn("_within", within).join(newer, ["source_id", "_slice"]).withColumn("kept", F.col("_later") + F.col("_within"))
    return total.where(F.col("kept") > most_bytes).groupBy("source_id").agg(F.max("last_ts").alias("cutoff"))


def newest_rows(a: Archive) -> DataFrame:
    """The newest time that each stream has or ever had: tail, segments and bounds."""
    bounds = a.bounds.where(F.col("kind") == STREAM_BOUND).select("source_id", F.col("name").alias("stream"), "ts")
    every = a.wal.select(*KEYS, "ts").union(a.segments.select(*KEYS, F.col("last_ts").alias("ts"))).union(bounds)
    return every.groupBy(*KEYS).agg(F.max("ts").alias("newest"))


def caller_floors(a: Archive) -> DataFrame:
    """source_id, stream, held, bound, floor, strict: what an appended caller row is held against.

    The floor is the newest time held or bounded; a row at the floor itself is
    admitted where a row is held there.
    """
    held = a.caller_rows.groupBy(*KEYS).agg(F.max("ts").alias("held"))
    bound = a.bounds.where(F.col("kind") == CALLER_BOUND).select("source_id", F.col("name").alias("stream"), F.col("ts").alias("bound"))
    both = held.join(bound, KEYS, "full")
    return both.withColumn("floor", F.greatest("held", "bound")).withColumn("strict", F.col("held").isNull() | (F.coalesce(F.col("bound") > F.col("held"), F.lit(False))))


def caller_positions(caller_rows: DataFrame) -> DataFrame:
    """The newest time of each name and the rows at it."""
    per = caller_rows.groupBy(*KEYS, "ts").agg(F.count("*").alias("n"))
    newest = per.groupBy(*KEYS).agg(F.max_by(F.struct("ts", "n"), "ts").alias("p"))
    return newest.select(*KEYS, F.col("p.ts").alias("newest"), F.col("p.n").alias("n_at_newest"))


def newest_bounds(bounds: DataFrame) -> DataFrame:
    return bounds.where(F.col("kind") == STREAM_BOUND).groupBy("source_id").agg(F.max("ts").alias("newest_bound"))


def next_seqs(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*KEYS).agg((F.max("seq") + 1).alias("next_seq"))


def source_spans(a: Archive) -> DataFrame:
    """First and last time of each source over segments and the live tail."""
    sealed = a.segments.select("source_id", "first_ts", "last_ts")
    tail = live(a.wal, a.segments).select("source_id", F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"))
    return sealed.union(tail).groupBy("source_id").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))


def oldest_rows(a: Archive) -> DataFrame:
    every = a.segments.select("source_id", F.col("first_ts").alias("ts")).union(a.wal.select("source_id", "ts"))
    return every.groupBy("source_id").agg(F.min("ts").alias("oldest"))


def liveness(observations: DataFrame) -> DataFrame:
    """State of a source at each observation (source_id, seen_at, heartbeat, complete, heartbeat_interval).

    Complete if it says so; unknown without a heartbeat or a positive interval;
    stopped when the heartbeat has stood for three intervals; live otherwise.
    """
    by_source = W.partitionBy("source_id").orderBy("seen_at")
    changed = F.col("heartbeat") != F.coalesce(F.lag("heartbeat").over(by_source), F.col("heartbeat") - 1)
    seen = observations.withColumn("_changed", F.when(changed, F.col("seen_at")))
    since = F.last("_changed", ignorenulls=True).over(by_source.rowsBetween(W.unboundedPreceding, 0))
    state = (
        F.when(F.col("complete"), "complete")
        .when(F.col("heartbeat").isNull() | F.col("heartbeat_interval").isNull() | (F.col("heartbeat_interval") <= 0), "unknown")
        .when(F.col("seen_at") - F.col("_since") >= STOPPED_AFTER_INTERVALS * F.col("heartbeat_interval"), "stopped")
        .otherwise("live")
    )
    return seen.withColumn("_since", since).select("source_id", "seen_at", state.alias("state"))
