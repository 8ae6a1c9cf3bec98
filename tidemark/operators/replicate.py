"""Replication: what a publisher sends of two snapshots' difference, what a subscriber makes of frames, where a copy resumes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import NO_STATE, fold_state
from ..model import KEYS, Archive
from ..sources.wire import MAX_FRAME, MOST_SPANS
from . import ingest, stats
from .scan import live


def ordinals(sources: DataFrame) -> DataFrame:
    """source_id and the ordinal that frames of a connection name it by. Sources are few: a row for each producer."""
    return sources.select(F.col("id").alias("source_id"), (F.row_number().over(W.orderBy("id")) - 1).cast("long").alias("ordinal"))


# --- publisher ---------------------------------------------------------------


def new_index_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Caller rows that come after a name's position (newest time, rows at it) in the old snapshot."""
    at = stats.caller_positions(old)
    rows = new.join(at, KEYS, "left").where("newest IS NULL OR ts >= newest")
    nth = F.row_number().over(W.partitionBy(*KEYS, "ts").orderBy("ord"))
    return rows.withColumn("_nth", nth).where("newest IS NULL OR ts > newest OR _nth > n_at_newest").drop("newest", "n_at_newest", "_nth")


def new_clock_offsets(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, ["source_id", "ts"], "left_anti")


def new_segments(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old, [*KEYS, "seq"], "left_anti")


def new_rows(old: Archive, new: Archive) -> DataFrame:
    """Live rows beyond what each stream had been sent: its newest row of the old snapshot."""
    sent = stats.newest_rows(old)
    return live(new.wal, new.segments).join(sent, KEYS, "left").where("newest IS NULL OR ts > newest").drop("newest")


def changes(old: Archive, new: Archive) -> DataFrame:
    """What a poll sends, counted: source_id, kind, n. Index entries go first, then clock observations, segments, rows."""
    parts = [
        ("Index", new_index_entries(old.caller_rows, new.caller_rows)),
        ("ClockOffset", new_clock_offsets(old.clock_offsets, new.clock_offsets)),
        ("Segment", new_segments(old.segments, new.segments)),
        ("Rows", new_rows(old, new)),
    ]
    out = None
    for kind, df in parts:
        counted = df.groupBy("source_id").agg(F.count("*").alias("n")).select("source_id", F.lit(kind).alias("kind"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


def with_states(entries: DataFrame) -> DataFrame:
    """Index entries (source_id, stream, ts, ord, blob) in sending order with the state after each: `state_a`, `state_b` as unsigned decimals, and `index_kind`, full for a name's first.

    The state folds over a source's entries one after another, so a source is
    one task, which streams.
    """
    ordered = entries.select("source_id", "stream", "ts", "ord", "blob").repartition("source_id").sortWithinPartitions("source_id", "ts", "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, state, seen = None, NO_STATE, set()
        for batch in batches:
            a, b, kinds = [], [], []
            for own, stream, ts, blob in zip(batch["source_id"], batch["stream"], batch["ts"], batch["blob"], strict=True):
                if own != source:
                    source, state, seen = own, NO_STATE, set()
                state = fold_state(state, [(int(ts), blob.encode() if isinstance(blob, str) else bytes(blob))])
                a.append(str(state[0]))
                b.append(str(state[1]))
                kinds.append("delta" if stream in seen else "full")
                seen.add(stream)
            yield batch.drop(columns="blob").assign(state_a=a, state_b=b, index_kind=kinds)

    return ordered.mapInPandas(run, "source_id long, stream string, ts long, ord long, state_a string, state_b string, index_kind string")


def packed(rows: DataFrame, size: str, most_bytes: int = MAX_FRAME) -> DataFrame:
    """rows (source_id, stream, ts, ...) with `frame`: an interval's rows in time and stream order, as many to a frame as fit.

    size: the column with a row's bytes. A row larger than a frame has its own.
    """
    ordered = rows.repartition("source_id").sortWithinPartitions("source_id", "ts", "stream")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", frame long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, frame, held = None, 0, 0
        for batch in batches:
            own, sizes = batch["source_id"].to_numpy(), batch[size].to_numpy()
            frames = np.empty(len(batch), np.int64)
            runs = np.nonzero(own[1:] != own[:-1])[0] + 1
            for b, e in zip([0, *runs.tolist()], [*runs.tolist(), len(batch)], strict=True):
                if e > b and own[b] != source:
                    source, frame, held = own[b], 0, 0
                total, at = np.cumsum(sizes[b:e]), 0
                while at < e - b:  # one step a frame: how far the sizes' sums let it reach
                    done = int(total[at - 1]) if at else 0
                    to = int(np.searchsorted(total, done + most_bytes - held, "right"))
                    if to == at and held:
                        frame, held = frame + 1, 0
                        continue
                    to = max(to, at + 1)
                    frames[b + at : b + to] = frame
                    held, at = held + int(total[to - 1]) - done, to
            yield batch.assign(frame=frames)

    return ordered.mapInPandas(run, ddl)


def sync_points(spans: DataFrame, wanted: DataFrame) -> DataFrame:
    """The largest time from low to high inside no span, for every stream; a span holds its first_ts but not its last_ts.

    spans: keys, first_ts, last_ts; wanted: keys, low, high -> keys, at (null: none).
    Spans that touch or overlap are one island, so a point inside moves to just before its island.
    """
    line = W.partitionBy(*KEYS).orderBy("first_ts", "last_ts")
    reach = F.max("last_ts").over(line.rowsBetween(W.unboundedPreceding, -1))
    starts = spans.where("first_ts < last_ts").withColumn("_new", F.when(reach.isNull() | (F.col("first_ts") > reach), 1).otherwise(0))
    islands = starts.withColumn("_island", F.sum("_new").over(line.rowsBetween(W.unboundedPreceding, 0))).groupBy(*KEYS, "_island").agg(F.min("first_ts").alias("_first"), F.max("last_ts").alias("_last"))
    inside = wanted.join(islands, KEYS).where("_first <= high AND high < _last").select(*KEYS, "_first")
    at = F.coalesce(F.col("_first") - 1, F.col("high"))
    return wanted.join(inside, KEYS, "left").select(*KEYS, F.when(at >= F.col("low"), at).alias("at"))


def resume_frames(held: DataFrame, spans: DataFrame, segments: DataFrame, oldest: DataFrame) -> DataFrame:
    """The frames that bring every stream of a resumed copy in step with its origin, a row each.

    held: keys, newest (the copy's newest row); spans: keys, first_ts, last_ts (what
    the copy has sealed); segments: the origin's catalog; oldest: keys, oldest (the
    origin's oldest row). Returned: keys, place, kind, at, until, n, seq, first_ts,
    last_ts; a stream's frames go by place, then first_ts.

    - Unavailable: rows after `at` and before `until` are gone from the origin.
    - Sync: the copy's boundary moves to `at`, since its own isn't a boundary of both.
    - SegmentGroup: the next n segments hold rows that the copy has live.
    - SegmentAfter: the segment that follows what ends `at`.
    - NoSyncPoint: the copy drew boundaries of its own; such a stream can't be resumed.
    """
    marks = spans.groupBy(*KEYS).agg(F.max("last_ts").alias("mark"))
    known = held.join(marks, KEYS, "left").join(oldest, KEYS, "left")
    reachable = F.when(F.col("oldest") <= F.col("newest"), F.col("oldest") - 1).otherwise(F.col("newest"))
    known = known.withColumn("low", reachable).withColumn("high", F.greatest("low", "mark"))
    either = spans.select(*KEYS, "first_ts", "last_ts").union(segments.select(*KEYS, "first_ts", "last_ts"))
    placed = known.join(sync_points(either, known.select(*KEYS, "low", "high")), KEYS).withColumn("synced", ~F.col("at").eqNullSafe(F.col("mark")))
    after = segments.join(placed, KEYS).where(F.col("last_ts") > F.col("at"))
    before = F.lag("last_ts").over(W.partitionBy(*KEYS).orderBy("first_ts"))
    following = after.withColumn("at", F.coalesce(before, "at"))
    grouped = after.where(~F.col("synced") & (F.col("first_ts") <= F.col("newest"))).groupBy(*KEYS).agg(F.count("*").alias("n")).where("n >= 2")

    def rows(df: DataFrame, place: int, kind: str, **columns: str) -> DataFrame:
        value = lambda c: (F.col(columns[c]) if c in columns else F.lit(None)).cast("long").alias(c)
        return df.select(*KEYS, F.lit(place).alias("place"), F.lit(kind).alias("kind"), *map(value, ("at", "until", "n", "seq", "first_ts", "last_ts")))

    return (
        rows(placed.where(F.col("oldest") > F.col("newest") + 1), 0, "Unavailable", at="newest", until="oldest")
        .union(rows(placed.where("at IS NULL"), 1, "NoSyncPoint", at="low", until="high"))
        .union(rows(placed.where("at IS NOT NULL AND synced"), 1, "Sync", at="at"))
        .union(rows(grouped, 2, "SegmentGroup", n="n"))
        .union(rows(following, 3, "SegmentAfter", at="at", n="n_rows", seq="seq", first_ts="first_ts", last_ts="last_ts"))
    )


# --- subscriber --------------------------------------------------------------


def gaps(frames: DataFrame) -> DataFrame:
    """frames (source, number, seq) with `missed`: intervals lost before a Rows frame. A repeated seq is one interval in several frames."""
    before = F.lag("seq").over(W.partitionBy("source").orderBy("number"))
    return frames.withColumn("missed", F.coalesce(F.greatest(F.col("seq") - before - 1, F.lit(0)), F.lit(0)))


def in_state(events: DataFrame) -> DataFrame:
    """Rows frames whose index state is what the source's entries before them left; others are skipped, and all before the first full entry.

    events: source, number, kind (Index or Rows), index_kind, state.
    """
    line = W.partitionBy("source").orderBy("number").rowsBetween(W.unboundedPreceding, -1)
    is_index = F.col("kind") == "Index"
    full = F.max(F.when(is_index & (F.col("index_kind") == "full"), 1)).over(line)
    held = F.last(F.when(is_index, F.col("state")), ignorenulls=True).over(line)
    judged = events.withColumns({"_held": held, "_full": full}).where("kind = 'Rows'")
    return judged.withColumn("applies", F.coalesce((F.col("_full") == 1) & (F.col("_held") == F.col("state")), F.lit(False))).drop("_held", "_full")


def deliver(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """rows (source_id, stream, number, ts, ord) of frames with `outcome`: accepted, or repeated in one way or the other.

    A row at or below what earlier frames brought its stream, or the second at a
    time within its frame, is a repeat: the rule that admits ticks.
    """
    floors = newest.select("source_id", F.lit(None).cast("long").alias("floor")).where("false")
    judged = ingest.admit(rows.withColumnRenamed("number", "tick"), newest, floors).withColumnRenamed("tick", "number")
    return judged.withColumn("outcome", F.when(F.col("outcome") == ingest.ACCEPTED, ingest.ACCEPTED).otherwise(ingest.REPEATED))


def resume_spans(a: Archive, most: int = MOST_SPANS) -> DataFrame:
    """uuid, stream, newest and the newest spans of each stream, newest first: what a copy asks to resume from."""
    newest = a.wal.select(*KEYS, "ts").union(a.segments.select(*KEYS, F.col("last_ts").alias("ts"))).groupBy(*KEYS).agg(F.max("ts").alias("newest"))
    nth = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("seq")))
    last = a.segments.withColumn("_nth", nth).where(F.col("_nth") <= most)
    spans = last.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("last_ts", "first_ts")), asc=False).alias("spans"))
    named = a.sources.where("uuid IS NOT NULL").select(F.col("id").alias("source_id"), "uuid")
    return newest.join(spans, KEYS, "left").join(named, "source_id").select("uuid", "stream", "newest", F.coalesce("spans", F.array().cast("array<struct<last_ts:bigint,first_ts:bigint>>")).alias("spans"))


def resume_request(a: Archive, since: int, most: int = MOST_SPANS) -> dict:
    """The request itself; it holds a row for each stream and name, 256 spans each at most, and must fit a frame."""
    sources: dict[str, dict] = {}
    entry = lambda uuid: sources.setdefault(uuid, {"uuid": uuid, "streams": [], "names": []})
    for r in resume_spans(a, most).toLocalIterator():
        entry(r.uuid)["streams"].append({"stream": r.stream, "newest": r.newest, "spans": [{"first_ts": s.first_ts, "last_ts": s.last_ts} for s in r.spans]})
    named = a.sources.where("uuid IS NOT NULL").select(F.col("id").alias("source_id"), "uuid")
    for r in stats.caller_positions(a.caller_rows).join(named, "source_id").toLocalIterator():
        entry(r.uuid)["names"].append({"name": r.stream, "ts": r.newest, "at_ts": r.n_at_newest})
    for s in sources.values():
        s["streams"].sort(key=lambda t: t["stream"].encode())
        s["names"].sort(key=lambda n: n["name"].encode())
    return {"since_for_new_sources": since, "sources": sorted(sources.values(), key=lambda s: s["uuid"].encode())}


def state_column(a: Column, b: Column) -> Column:
    return F.concat_ws(":", a, b)
