"""Rewriting: compaction, copies by range and filter, projection, combining archives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import CALLER_BOUND, KEYS, STREAM_BOUND, Archive
from . import documents, stats
from .ingest import as_bounds, patched, raise_bounds
from .scan import live, overlapping

SEQ = [*KEYS, "seq"]
STOP_AT_CHANGE, UNION_FIELDS = "stop_at_change", "union_fields"


class IdenticalMetadata:
    """A merge of file metadata that takes only equal ones, whatever their order."""

    def start(self, metadata: dict[str, str]):
        return metadata

    def extend(self, state, metadata: dict[str, str]):
        """The state with one more segment, or None if the run has to stop before it."""
        return state if metadata == state else None


def plan_runs(segments: DataFrame, target_rows: int, schema: str = STOP_AT_CHANGE, merge: IdenticalMetadata | None = None) -> DataFrame:
    """The catalog with `run`, the seq of the first segment of the run that each belongs to.

    A run goes on while its rows stay within target_rows, its segments' fields
    agree by the schema policy, and their metadata merges. Optional columns:
    fields map<string,string> (a field's type, nullability and metadata by name)
    and metadata map<string,string>. Where a run ends depends on where it began,
    so a stream's catalog is read in order by one task, streaming; payload isn't.
    """
    if schema not in (STOP_AT_CHANGE, UNION_FIELDS):
        raise ValueError(f"no such schema policy: {schema}")
    merge, most = merge or IdenticalMetadata(), max(1, target_rows)
    for name in ("fields", "metadata"):
        if name not in segments.columns:
            segments = segments.withColumn(name, F.create_map().cast("map<string,string>"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields) + ", run long"

    def taken(fields: dict, more: dict) -> dict | None:
        if schema == STOP_AT_CHANGE:
            return fields if fields == more else None
        return None if any(fields.get(k, v) != v for k, v in more.items()) else fields | more

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = first = None
        rows, fields, state = 0, {}, None
        for batch in batches:
            found = []
            for source, stream, seq, n, own, kv in zip(*(batch[c].tolist() for c in (*SEQ, "n_rows", "fields", "metadata")), strict=True):
                own, kv = dict(own or {}), dict(kv or {})
                wider = taken(fields, own) if (source, stream) == key and rows + n <= most else None
                merged = merge.extend(state, kv) if wider is not None else None
                if merged is None:
                    key, first, rows, fields, state = (source, stream), seq, n, own, merge.start(kv)
                else:
                    rows, fields, state = rows + n, wider, merged
                found.append(first)
            yield batch.assign(run=pd.array(found, "Int64"))

    return segments.repartition(*KEYS).sortWithinPartitions(*SEQ).mapInPandas(run, ddl)


@dataclass(frozen=True)
class Compacted:
    archive: Archive
    report: DataFrame  # keys, before, after, merges


def compact(a: Archive, target_rows: int, schema: str = STOP_AT_CHANGE, merge: IdenticalMetadata | None = None) -> Compacted:
    """Merges runs of segments: the first's seq, all rows, the whole span; merged segments lose their caller index."""
    planned = plan_runs(a.segments, target_rows, schema, merge).select(*SEQ, "run", "n_rows", "first_ts", "last_ts", "n_bytes")
    segments = planned.groupBy(*KEYS, F.col("run").alias("seq")).agg(F.sum("n_rows").alias("n_rows"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("_parts"))
    report = segments.groupBy(*KEYS).agg(F.sum("_parts").alias("before"), F.count("*").alias("after"), F.count_if(F.col("_parts") > 1).alias("merges"))
    payload = a.payload.join(planned.select(*SEQ, "run"), SEQ).withColumn("seq", F.col("run")).drop("run")
    alone = segments.where("_parts = 1").select(*SEQ)
    return Compacted(replace(a, segments=segments.drop("_parts"), payload=payload, segment_indexes=a.segment_indexes.join(alone, SEQ, "left_semi")), report)


@dataclass(frozen=True)
class CopySpec:
    """What a copy takes. Conditions are on the columns of sources, and on `stream`; no bound means everything."""

    sources: Column | None = None
    streams: Column | None = None
    start: int | None = None
    end: int | None = None
    columns: list[str] | None = None  # of the payload, besides seq and ts; None: all
    data_columns: list[str] = field(default_factory=list)  # without one of these kept, a segment is dropped
    metadata_extra: dict[str, str] = field(default_factory=dict)
    encodes: Column | None = None  # the live rows that the encoder keeps; None: all


def project(payload: DataFrame, columns: list[str], data_columns: list[str]) -> DataFrame:
    """Keys and the columns kept; nothing if none of them is data."""
    kept = payload.select(*SEQ, "ts", *[c for c in columns if c in payload.columns])
    return kept if set(columns) & set(data_columns) else kept.where("false")


def copy(a: Archive, spec: CopySpec) -> Archive:
    """Sources, streams and a time range of an archive.

    Segments that meet the range come whole and are numbered from 0; a tail whose
    span meets it is encoded as one more segment, and the live rows after what
    the encoder kept stay tail rows. Clock observations and documents come all,
    caller rows of the range come under their names, and bounds are carried.
    """
    everything = F.lit(True)
    sources = a.sources if spec.sources is None else a.sources.where(spec.sources)
    if spec.metadata_extra:
        extra = F.create_map(*[F.lit(x) for kv in spec.metadata_extra.items() for x in kv])
        sources = sources.withColumn("metadata", patched(F.col("metadata"), extra))
    ids = sources.select(F.col("id").alias("source_id"))
    streams = everything if spec.streams is None else spec.streams
    mine = lambda df, names=True: df.join(ids, "source_id", "left_semi").where(streams if names else everything)
    within = lambda lo, hi: (everything if spec.end is None else F.col(lo) <= spec.end) & (everything if spec.start is None else F.col(hi) >= spec.start)

    taken = mine(a.segments).where(within("first_ts", "last_ts"))
    numbered = taken.withColumn("new_seq", F.row_number().over(W.partitionBy(*KEYS).orderBy("seq")) - 1)
    to = numbered.select(*SEQ, "new_seq")
    sealed = a.payload.join(to, SEQ).withColumn("seq", F.col("new_seq").cast("long")).drop("new_seq")
    indexes = a.segment_indexes.join(to, SEQ).withColumn("seq", F.col("new_seq").cast("long")).drop("new_seq")

    tail = mine(live(a.wal, a.segments))
    spans = tail.groupBy(*KEYS).agg(F.min("ts").alias("_first"), F.max("ts").alias("_last")).where(within("_first", "_last"))
    tail = tail.join(spans.select(*KEYS), KEYS, "left_semi")
    encoded = tail if spec.encodes is None else tail.where(spec.encodes)
    marks = encoded.groupBy(*KEYS).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    after = numbered.groupBy(*KEYS).agg((F.max("new_seq") + 1).alias("seq"))
    last = marks.join(after, KEYS, "left").withColumn("seq", F.coalesce("seq", F.lit(0)).cast("long"))
    left = tail.join(marks.select(*KEYS, "last_ts"), KEYS, "left").where("last_ts IS NULL OR ts > last_ts").drop("last_ts")

    columns = [c for c in a.payload.columns if c not in SEQ]
    payload = sealed.unionByName(encoded.join(last.select(*KEYS, "seq"), KEYS).select(*SEQ, *columns))
    segments = numbered.withColumn("seq", F.col("new_seq").cast("long")).select(*SEQ, "n_rows", "first_ts", "last_ts", "n_bytes")
    segments = segments.unionByName(last.withColumn("n_bytes", F.lit(None).cast("long")).select(*SEQ, "n_rows", "first_ts", "last_ts", "n_bytes"))
    if spec.columns is not None:
        payload = project(payload, spec.columns, spec.data_columns)
        segments = segments if set(spec.columns) & set(spec.data_columns) else segments.where("false")
        indexes, left = indexes.where("false"), left.where("false")

    bounds = as_bounds(mine(stats.newest_rows(a).withColumnRenamed("newest", "ts")), STREAM_BOUND)
    callers = mine(a.caller_rows).where(within("ts", "ts"))
    newest = callers.groupBy(*KEYS).agg(F.max("ts").alias("_got"))
    floors = mine(stats.caller_floors(a)).join(newest, KEYS, "left").where("_got IS NULL OR _got < floor").select(*KEYS, F.col("floor").alias("ts"))
    bounds = bounds.unionByName(as_bounds(floors, CALLER_BOUND))
    return Archive(sources, segments, payload, left, indexes, mine(a.clock_offsets, False), callers, a.documents, bounds)


def shared_sources(a: Archive, b: Archive) -> DataFrame:
    """uuids that both have, with b's id, which is their order; a null uuid is never shared."""
    return b.sources.where("uuid IS NOT NULL").select("uuid", "id").join(a.sources.select("uuid"), "uuid", "left_semi")


class DuplicateSource(ValueError):
    """Both archives hold a source of one uuid."""


def combine(a: Archive, b: Archive) -> Archive:
    """b's sources after a's, under new ids, and the documents of both, a's first.

    DuplicateSource if they share a source's uuid, DocumentConflict if they hold a
    revision with different content.
    """
    twice = shared_sources(a, b).orderBy("id").limit(1).collect()
    if twice:
        raise DuplicateSource(f"both archives hold source {twice[0].uuid}")
    docs = documents.copy(b.documents, a.documents)
    documents.refuse(docs.conflicts)
    last = a.sources.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    shift = b.sources.select("id").withColumn("_n", F.row_number().over(W.orderBy("id"))).crossJoin(last).select(F.col("id").alias("_id"), (F.col("_last") + F.col("_n")).alias("_to"))  # one row
    moved = lambda df, key="source_id": df.join(shift, F.col(key) == F.col("_id")).withColumn(key, F.col("_to")).drop("_id", "_to")
    parts = {name: getattr(a, name).unionByName(moved(getattr(b, name)), allowMissingColumns=True) for name in ("segments", "payload", "wal", "segment_indexes", "clock_offsets", "caller_rows", "bounds")}
    return Archive(sources=a.sources.unionByName(moved(b.sources, "id")), documents=a.documents.unionByName(docs.inserted), **parts)


def renamed_streams(a: Archive, f: Callable[[Column], Column]) -> Archive:
    """An archive whose streams have other names; f has to keep them apart."""
    parts = {name: getattr(a, name).withColumn("stream", f(F.col("stream"))) for name in ("segments", "payload", "wal", "segment_indexes", "caller_rows")}
    return replace(a, **parts, bounds=raise_bounds(a.bounds, a.bounds.where("false")).withColumn("name", f(F.col("name"))))
