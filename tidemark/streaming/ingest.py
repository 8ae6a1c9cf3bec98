"""Streaming ingest: a micro-batch is admitted against what the store holds and appended as one version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import KEYS, STOPPED_AFTER_INTERVALS, WAL
from ..operators import ingest, seal, stats
from ..operators.scan import live
from ..sources.store import Append, Store

TAIL = [c.split()[0] for c in WAL.split(", ")]


def append_batch(store: Store, batch: DataFrame, batch_id: int, floors: DataFrame | None = None) -> bool:
    """Admits one micro-batch (source_id, stream, tick, ts, ord, wall_offset, row). False if the batch is in already.

    The manifest notes the last batch, so a batch that runs again after a failure is written once.
    """
    note = store.manifest()
    if int(note["notes"].get("batch", -1)) >= batch_id:
        return False
    spark = batch.sparkSession
    floors = spark.createDataFrame([], "source_id BIGINT, floor BIGINT") if floors is None else floors
    judged = ingest.admit(batch, stats.newest_rows(store.snapshot(note["version"])), floors)
    store.commit({"wal": Append(judged.where(F.col("outcome") == ingest.ACCEPTED).select(*TAIL))}, expected=note["version"], notes={"batch": str(batch_id)})
    return True


def start(stream: DataFrame, store: Store, checkpoint: str, floors: DataFrame | None = None, **trigger) -> StreamingQuery:
    def each(batch: DataFrame, batch_id: int) -> None:
        append_batch(store, batch, batch_id, floors)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def seal_store(store: Store, max_rows: int, slice_width: int, keep_shadowed: bool = False) -> int:
    """Seals the store's live rows as one version: segments, payload, clock observations, and a tail without what they cover."""
    version = store.manifest()["version"]
    a = store.snapshot(version)
    parts = seal.sealed_parts(live(a.wal, a.segments), stats.next_seqs(a.segments), max_rows, slice_width)
    segments = seal.segments_of(parts).join(parts.groupBy(*KEYS, "seq").agg(F.sum(F.octet_length("row")).alias("n_bytes")), [*KEYS, "seq"])
    observed = ingest.add_clock_offsets(a.clock_offsets, seal.observations(parts).withColumn("ord", F.lit(0)))
    changes = {"segments": Append(segments), "payload": Append(parts), "clock_offsets": Append(observed.select("source_id", "ts", "offset_ns"))}
    if not keep_shadowed:
        changes["wal"] = a.wal.where("false")
    return store.commit(changes, expected=version)


STATE_SQL = "source_id long, seen_at long, state string"


def liveness(observations: DataFrame) -> DataFrame:
    """stats.liveness() over a stream of observations: state is each source's last heartbeat and when it changed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        beat, since = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("seen_at")  # one source's observations of one micro-batch
        out = []
        for r in rows.itertuples(index=False):
            own = None if pd.isna(r.heartbeat) else int(r.heartbeat)
            if own is not None and own != beat:
                beat, since = own, int(r.seen_at)
            if r.complete:
                said = "complete"
            elif own is None or pd.isna(r.heartbeat_interval) or r.heartbeat_interval <= 0:
                said = "unknown"
            else:
                said = "stopped" if r.seen_at - since >= STOPPED_AFTER_INTERVALS * r.heartbeat_interval else "live"
            out.append((key[0], int(r.seen_at), said))
        state.update((beat, since))
        yield pd.DataFrame(out, columns=["source_id", "seen_at", "state"])

    return observations.groupBy("source_id").applyInPandasWithState(step, STATE_SQL, "heartbeat long, since long", "append", GroupStateTimeout.NoTimeout)
