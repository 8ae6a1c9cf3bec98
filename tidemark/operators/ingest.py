"""Ingest: admission of ordered appends, sources, caller rows, clock observations, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CALLER_BOUND, KEYS, STREAM_BOUND
from .stats import newest_rows

ACCEPTED, BELOW_FLOOR, LATE, REPEATED = "accepted", "below_floor", "late", "repeated"


def admit(rows: DataFrame, newest: DataFrame, floors: DataFrame) -> DataFrame:
    """Rows (keys, tick, ts, ord, ...) with `outcome`.

    newest: keys, newest, before the first tick. floors: source_id, floor of
    resumed sources. A source's tick with any row at or below its floor goes as a
    whole. Then a row at or below its stream's newest before its tick is late,
    and of rows at one time within a tick the first to arrive stays. A dropped
    row never exceeds what its stream already holds, so the newest before a tick
    is the maximum over all rows of earlier ticks, accepted or not. Only the
    maxima of (stream, tick) are ordered, not rows.
    """
    below = rows.groupBy("source_id", "tick").agg(F.min("ts").alias("_lo")).join(floors, "source_id").where(F.col("_lo") <= F.col("floor")).select("source_id", "tick", F.lit(True).alias("_below"))
    marked = rows.join(below, ["source_id", "tick"], "left").withColumn("_below", F.coalesce("_below", F.lit(False)))
    tops = marked.where("NOT _below").groupBy(*KEYS, "tick").agg(F.max("ts").alias("_top"))
    earlier = F.max("_top").over(W.partitionBy(*KEYS).orderBy("tick").rowsBetween(W.unboundedPreceding, -1))
    bounds = tops.withColumn("_earlier", earlier).join(newest, KEYS, "left").select(*KEYS, "tick", F.greatest("_earlier", "newest").alias("_bound"))
    judged = marked.join(bounds, [*KEYS, "tick"], "left")
    first = F.row_number().over(W.partitionBy(*KEYS, "tick", "ts", "_below").orderBy("ord"))
    outcome = F.when(F.col("_below"), BELOW_FLOOR).when(F.col("ts") <= F.col("_bound"), LATE).when(F.col("_nth") > 1, REPEATED).otherwise(ACCEPTED)
    return judged.withColumn("_nth", first).withColumn("outcome", outcome).drop("_below", "_bound", "_nth")


def dropped(judged: DataFrame) -> DataFrame:
    """Rows that were dropped as late or repeated, for each source; a tick below a floor isn't counted here."""
    return judged.groupBy("source_id").agg(F.count_if(F.col("outcome").isin(LATE, REPEATED)).alias("n_dropped"))


def admit_replica(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """A copy's ticks are all or nothing: from a source's first tick with a late or repeated row on, nothing is written."""
    floors = newest.select("source_id", F.lit(None).cast("long").alias("floor")).where("false")
    judged = admit(rows, newest, floors)
    poisoned = judged.where(F.col("outcome") != ACCEPTED).groupBy("source_id").agg(F.min("tick").alias("_stop"))
    return judged.join(poisoned, "source_id", "left").withColumn("outcome", F.when(F.col("_stop").isNull() | (F.col("tick") < F.col("_stop")), ACCEPTED).otherwise("poisoned")).drop("_stop")


def floors_of(archive) -> DataFrame:
    """The floor that a resumed source gets: the newest time it ever held."""
    return newest_rows(archive).groupBy("source_id").agg(F.max("newest").alias("floor"))


def add_sources(sources: DataFrame, new: DataFrame) -> DataFrame:
    """new (ord, uuid, ...) with `accepted`: refused where an archive's source or an earlier new one has the uuid. A null uuid equals none."""
    held = sources.where("uuid IS NOT NULL").select("uuid", F.lit(True).alias("_held")).distinct()
    nth = F.row_number().over(W.partitionBy("uuid").orderBy("ord"))
    judged = new.withColumn("_nth", F.when(F.col("uuid").isNull(), 1).otherwise(nth)).join(held, "uuid", "left")
    return judged.withColumn("accepted", F.col("_held").isNull() & (F.col("_nth") == 1)).drop("_held", "_nth")


def resume(sources: DataFrame, floors: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (id, anchor) against what each source ever held: a timeline must go on after it."""
    r = requests.join(sources.select("id"), "id", "left_semi").join(floors, F.col("id") == F.col("source_id"), "left")
    return r.select("id", "anchor", "floor", F.when(F.col("anchor") <= F.col("floor"), "timeline_backwards").otherwise("resumed").alias("outcome"))


def admit_caller_rows(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """rows (keys, ts, ord, blob) with `accepted`; floors as caller_floors() gives them. Order within a call is free."""
    ok = F.col("floor").isNull() | (F.col("ts") > F.col("floor")) | (~F.col("strict") & (F.col("ts") == F.col("floor")))
    return rows.join(floors.select(*KEYS, "floor", "strict"), KEYS, "left").withColumn("accepted", ok).drop("floor", "strict")


def add_clock_offsets(held: DataFrame, new: DataFrame) -> DataFrame:
    """What of new (source_id, ts, offset_ns, ord) is inserted: the first observation at a time wins."""
    first = new.groupBy("source_id", "ts").agg(F.min_by("offset_ns", "ord").alias("offset_ns"))
    return first.join(held, ["source_id", "ts"], "left_anti")


def patched(metadata: Column, patch: Column) -> Column:
    """The map with the patch's entries over its own."""
    keys = F.array_distinct(F.concat(F.map_keys(metadata), F.map_keys(patch)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(F.map_contains_key(patch, k), patch[k]).otherwise(metadata[k])))


def raise_bounds(bounds: DataFrame, raised: DataFrame) -> DataFrame:
    """Bounds only rise: the maximum of what is held and what is recorded."""
    return bounds.unionByName(raised).groupBy("source_id", "kind", "name").agg(F.max("ts").alias("ts"))


def as_bounds(tops: DataFrame, kind: int) -> DataFrame:
    """keys and ts as rows of bounds."""
    if kind not in (STREAM_BOUND, CALLER_BOUND):
        raise ValueError(f"no such kind of bound: {kind}")
    return tops.select("source_id", F.lit(kind).alias("kind"), F.col("stream").alias("name"), "ts")


def finalize(sources: DataFrame, source_id: int, complete: bool = True) -> DataFrame:
    """sources with one marked complete, or incomplete again."""
    return sources.withColumn("complete", F.when(F.col("id") == source_id, complete).otherwise(F.col("complete")))


def beat(sources: DataFrame, source_id: int, interval: int) -> DataFrame:
    """sources with one's heartbeat advanced; its first beat says how often more will come."""
    mine = F.col("id") == source_id
    return sources.withColumns({
        "heartbeat": F.when(mine, F.coalesce("heartbeat", F.lit(0)) + 1).otherwise(F.col("heartbeat")),
        "heartbeat_interval": F.when(mine, F.lit(interval).cast("long")).otherwise(F.col("heartbeat_interval")),
    })
