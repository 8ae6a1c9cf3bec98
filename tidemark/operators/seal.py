"""Sealing: live rows become segments; when they should, and adopting segments made elsewhere."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import STAGGER_BUCKETS
from ..functions.times import ranked
from ..model import KEYS, STREAM_BOUND, Archive
from . import stats
from .ingest import add_clock_offsets, as_bounds, raise_bounds
from .scan import live, watermarks


@dataclass(frozen=True)
class SealPolicy:
    max_bytes: int = 8 << 20
    max_rows: int = 900
    max_age: int = 300_000_000_000
    align: int | None = None

    def staggered(self, bucket: int) -> "SealPolicy":
        """The caps of a stream's first segment, up to half shorter, so that streams don't all seal at once."""
        less = lambda cap, least: max(cap - cap // (2 * STAGGER_BUCKETS) * bucket, least)
        return SealPolicy(less(self.max_bytes, 1), less(self.max_rows, 1), less(self.max_age, 0), self.align)


def sealed_parts(live: DataFrame, next_seqs: DataFrame, max_rows: int, slice_width: int) -> DataFrame:
    """Live rows with the seq of the segment that takes them: runs of max_rows in time order after what the stream has."""
    r = ranked(live, KEYS, "ts", [], slice_width).join(next_seqs, KEYS, "left")
    part = F.expr(f"(rn - 1) div {max(1, max_rows)}")
    return r.withColumn("seq", F.coalesce("next_seq", F.lit(0)) + part).drop("rn", "n_of_key", "next_seq")


def segments_of(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS, "seq").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def tiled(parts: DataFrame, encoded: DataFrame) -> DataFrame:
    """Segments of a capped seal, after looking at what the encoder covered.

    parts: keys, seq, ts. encoded: keys, seq, ts of the rows that it kept. Parts
    must meet at inner edges; where the encoder dropped a row at one, or all of a
    part, the stream's rows are sealed as one segment instead. `fallback` tells.
    """
    whole = parts.groupBy(*KEYS, "seq").agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
    kept = encoded.groupBy(*KEYS, "seq").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    ends = whole.groupBy(*KEYS).agg(F.min("seq").alias("_from"), F.max("seq").alias("_to"))
    both = whole.join(kept, [*KEYS, "seq"], "left").join(ends, KEYS)
    left_ok = (F.col("seq") == F.col("_from")) | F.coalesce(F.col("first_ts") == F.col("_first"), F.lit(False))
    right_ok = (F.col("seq") == F.col("_to")) | F.coalesce(F.col("last_ts") == F.col("_last"), F.lit(False))
    single = F.col("_from") == F.col("_to")
    judged = both.withColumn("_ok", single | (F.col("n_rows").isNotNull() & left_ok & right_ok))
    bad = judged.groupBy(*KEYS).agg(F.bool_or(~F.col("_ok")).alias("fallback"), F.min("seq").alias("_seq"))
    one = judged.join(bad, KEYS).withColumn("seq", F.when(F.col("fallback"), F.col("_seq")).otherwise(F.col("seq")))
    out = one.groupBy(*KEYS, "seq", "fallback").agg(F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    return out.where("n_rows > 0")


def observations(parts: DataFrame) -> DataFrame:
    """One clock observation for each source of a seal: its newest sealed row; of equal times the later stream's."""
    o = F.max_by(F.struct("ts", "wall_offset"), F.struct("ts", "stream"))
    return parts.groupBy("source_id").agg(o.alias("o")).select("source_id", F.col("o.ts").alias("ts"), F.col("o.wall_offset").alias("offset_ns"))


def due(rows: DataFrame, policy: SealPolicy, first: Column | None = None) -> DataFrame:
    """rows (keys, ts, n_bytes) with seq: segments cut as the policy's caps fall due.

    A segment ends with the row that reaches a cap, or before one that starts
    another aligned bucket. first: a stream's stagger bucket, for its first
    segment. Each cut depends on the one before, so a stream is read in order by
    one task; it streams through, and a task holds one batch.
    """
    ordered = rows.withColumn("_stagger", F.lit(0) if first is None else first).repartition(*KEYS).sortWithinPartitions(*KEYS, "ts")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", seq long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, seq, n, size, opened, bucket, caps = None, 0, 0, 0, 0, None, policy
        for batch in batches:
            seqs = np.empty(len(batch), np.int64)
            columns = (batch["source_id"].tolist(), batch["stream"].tolist(), batch["ts"].tolist(), batch["n_bytes"].tolist(), batch["_stagger"].tolist())
            for i, (source, stream, ts, n_bytes, stagger) in enumerate(zip(*columns, strict=True)):
                if (source, stream) != key:
                    key, seq, n, caps = (source, stream), 0, 0, policy.staggered(stagger)
                own = ts // policy.align if policy.align and policy.align > 0 else None
                if n and own != bucket:
                    seq, n, caps = seq + 1, 0, policy
                if not n:
                    size, opened, bucket = 0, ts, own
                n, size, seqs[i] = n + 1, size + n_bytes, seq
                if size >= caps.max_bytes or n >= caps.max_rows or ts - opened >= caps.max_age:
                    seq, n, caps = seq + 1, 0, policy
            yield batch.drop(columns="_stagger").assign(seq=seqs)

    return ordered.mapInPandas(run, schema)


def adoption(offered: DataFrame, marks: DataFrame, live: DataFrame) -> DataFrame:
    """offered (keys, n_rows, first_ts, last_ts, ...) with `outcome`, one offer a stream.

    invalid: no rows, or ends before it begins; held: at or below the watermark;
    straddles: begins there and ends beyond; covers_live: reaches a live row.
    """
    oldest = live.groupBy(*KEYS).agg(F.min("ts").alias("_oldest"))
    o = offered.join(marks, KEYS, "left").join(oldest, KEYS, "left")
    outcome = (
        F.when((F.col("n_rows") == 0) | (F.col("first_ts") > F.col("last_ts")), "invalid")
        .when(F.col("last_ts") <= F.col("mark"), "held")
        .when(F.col("first_ts") <= F.col("mark"), "straddles")
        .when(F.col("last_ts") >= F.col("_oldest"), "covers_live")
        .otherwise("adopted")
    )
    return o.withColumn("outcome", outcome).drop("mark", "_oldest")


def group_adoption(parts: DataFrame, marks: DataFrame, live: DataFrame) -> DataFrame:
    """For each stream whether its run of parts (keys, ord, after, n_rows, first_ts, last_ts) is adopted, all or nothing, and the live rows it prunes.

    Each part follows what lies sealed up to `after`; live rows below `after` are
    an error, those between it and the part's first row are pruned, those that
    the part covers are replaced.
    """
    line = W.partitionBy(*KEYS).orderBy("ord")
    p = parts.join(marks, KEYS, "left").withColumn("_sealed", F.coalesce(F.lag("last_ts").over(line), F.col("mark")))
    p = p.withColumn("_covered", F.max("last_ts").over(line.rowsBetween(W.unboundedPreceding, -1)))
    broken = (F.col("n_rows") == 0) | (F.col("first_ts") > F.col("last_ts")) | (F.col("last_ts") <= F.col("after"))
    overlap = F.coalesce((F.col("_sealed") > F.col("after")) | (F.col("first_ts") <= F.col("_sealed")), F.lit(False))
    judged = p.withColumn("_problem", F.when(broken, "invalid").when(overlap, "overlaps"))
    # The first part is held against all live rows, later ones against those beyond the parts before.
    hits = judged.select(*KEYS, "ord", "after", "first_ts", "_covered").join(live.select(*KEYS, "ts"), KEYS).where("_covered IS NULL OR ts > _covered")
    counted = hits.groupBy(*KEYS, "ord").agg(F.count_if(F.col("ts") <= F.col("after")).alias("_below"), F.count_if((F.col("ts") > F.col("after")) & (F.col("ts") < F.col("first_ts"))).alias("_pruned"))
    full = judged.join(counted, [*KEYS, "ord"], "left").withColumn("_problem", F.coalesce("_problem", F.when(F.coalesce("_below", F.lit(0)) > 0, "live_below")))
    out = full.groupBy(*KEYS).agg(F.min_by("_problem", F.when(F.col("_problem").isNotNull(), F.col("ord"))).alias("problem"), F.sum(F.coalesce("_pruned", F.lit(0))).alias("pruned"))
    return out.select(*KEYS, F.coalesce("problem", F.lit("adopted")).alias("outcome"), F.when(F.col("problem").isNull(), F.col("pruned")).otherwise(0).alias("pruned"))


def sync(segments: DataFrame, wal: DataFrame, points: DataFrame) -> DataFrame:
    """What cutting streams at points (keys, at) does: outcome, rows sealed, rows replaced, bound recorded.

    Live rows up to the point are sealed, everything beyond it goes. A point
    strictly inside a segment is refused.
    """
    s = segments.join(points, KEYS)
    by = s.groupBy(*KEYS).agg(
        F.bool_or((F.col("first_ts") <= F.col("at")) & (F.col("at") < F.col("last_ts"))).alias("_inside"), F.max("last_ts").alias("mark"), F.sum(F.when(F.col("first_ts") > F.col("at"), F.col("n_rows")).otherwise(0)).alias("_gone"),
    )
    rows = wal.join(points, KEYS).join(by.select(*KEYS, "mark"), KEYS, "left")
    alive = F.col("mark").isNull() | (F.col("ts") > F.col("mark"))
    tail = rows.groupBy(*KEYS).agg(F.count_if(alive & (F.col("ts") <= F.col("at"))).alias("_sealed"), F.count_if(alive & (F.col("ts") > F.col("at"))).alias("_cut"), F.max("ts").alias("_newest"))
    out = points.join(by, KEYS, "left").join(tail, KEYS, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    inside = F.coalesce("_inside", F.lit(False))
    newest = F.greatest("_newest", "mark")
    return out.select(
        *KEYS, "at", F.when(inside, "inside_segment").otherwise("synced").alias("outcome"), F.when(inside, 0).otherwise(zero("_sealed")).alias("sealed"),
        F.when(inside, 0).otherwise(zero("_gone") + zero("_cut")).alias("replaced"), F.when(~inside & (newest > F.col("at")), newest).alias("bound"),
    )


def _catalog(segments: DataFrame, a: Archive) -> DataFrame:
    """Segments in the catalog's columns; what isn't known of new ones, such as their size on disk, is null."""
    missing = {c: F.lit(None).cast(a.segments.schema[c].dataType) for c in a.segments.columns if c not in segments.columns}
    return segments.withColumns(missing).select(*a.segments.columns) if missing else segments.select(*a.segments.columns)


def sealed(a: Archive, max_rows: int, slice_width: int) -> Archive:
    """The archive with all live rows sealed: segments, payload, a clock observation for each source, no tail left."""
    parts = sealed_parts(live(a.wal, a.segments), stats.next_seqs(a.segments), max_rows, slice_width)
    observed = add_clock_offsets(a.clock_offsets, observations(parts).withColumn("ord", F.lit(0)))
    return replace(
        a, segments=a.segments.unionByName(_catalog(segments_of(parts), a)), payload=a.payload.unionByName(parts.select(*a.payload.columns)),
        wal=a.wal.where("false"), clock_offsets=a.clock_offsets.unionByName(observed.select(*a.clock_offsets.columns)),
    )


def adopted(a: Archive, offered: DataFrame, payload: DataFrame) -> Archive:
    """The archive with the offers that adoption() takes, one a stream, at their streams' next seq; payload: keys, ts and the payload's columns."""
    taken = adoption(offered, watermarks(a.segments), live(a.wal, a.segments)).where("outcome = 'adopted'").join(stats.next_seqs(a.segments), KEYS, "left").withColumn("seq", F.coalesce("next_seq", F.lit(0)))
    rows = payload.join(taken.select(*KEYS, "seq"), KEYS)
    return replace(a, segments=a.segments.unionByName(_catalog(taken, a)), payload=a.payload.unionByName(rows.select(*a.payload.columns)))


def synced(a: Archive, points: DataFrame) -> Archive:
    """The archive after its streams are cut at points (keys, at): live rows up to a point sealed, all beyond it gone.

    Streams whose point lies inside a segment stay as they are; see sync().
    """
    cut = sync(a.segments, a.wal, points).where("outcome = 'synced'").select(*KEYS, "at", "bound")
    at = cut.select(*KEYS, "at")
    alive = live(a.wal, a.segments).join(at, KEYS).where(F.col("ts") <= F.col("at")).drop("at")
    new = alive.join(stats.next_seqs(a.segments), KEYS, "left").withColumn("seq", F.coalesce("next_seq", F.lit(0))).drop("next_seq")
    kept = a.segments.join(at, KEYS, "left").where("at IS NULL OR first_ts <= at").drop("at")
    k = [*KEYS, "seq"]
    keys = kept.select(*k)
    bounds = cut.where("bound IS NOT NULL").select(*KEYS, F.col("bound").alias("ts"))
    return replace(
        a, segments=kept.unionByName(_catalog(segments_of(new), a)), payload=a.payload.join(keys, k, "left_semi").unionByName(new.select(*a.payload.columns)),
        segment_indexes=a.segment_indexes.join(keys, k, "left_semi"), wal=a.wal.join(at, KEYS, "left_anti"), bounds=raise_bounds(a.bounds, as_bounds(bounds, STREAM_BOUND)),
    )
