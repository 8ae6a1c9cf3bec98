"""Materialised reads: catalog, seam-free stream reads, probes, contract checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, Archive
from . import stats
from .scan import live, overlapping, payload_within


def catalog(a: Archive) -> DataFrame:
    """A row for each stream: its sealed and live spans; no payload is read."""
    sealed = stats.sealed_spans(a.segments).withColumnsRenamed({"n_rows": "sealed_rows", "first_ts": "sealed_first", "last_ts": "sealed_last"})
    tail = stats.live_spans(a).withColumnsRenamed({"n_rows": "live_rows", "first_ts": "live_first", "last_ts": "live_last"})
    # Streams of shadowed tail rows alone have a segment too, so the two sides hold every stream.
    both = sealed.join(tail, KEYS, "full")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_segments", "sealed_rows", "n_bytes", "live_rows")}
    return both.withColumns(zero)


def rows_and_span(catalogued: DataFrame) -> DataFrame:
    """Sealed and live together, for each stream."""
    return catalogued.select(*KEYS, (F.col("sealed_rows") + F.col("live_rows")).alias("n_rows"), F.least("sealed_first", "live_first").alias("first_ts"), F.greatest("sealed_last", "live_last").alias("last_ts"))


def describe(a: Archive) -> DataFrame:
    """Totals of the archive, in one row."""
    c = catalog(a)
    return c.agg(
        F.countDistinct("source_id").alias("n_sources"), F.count("*").alias("n_streams"), F.sum("n_segments").alias("n_segments"), F.sum(F.col("sealed_rows") + F.col("live_rows")).alias("n_rows"),
        F.min(F.least("sealed_first", "live_first")).alias("first_ts"), F.max(F.greatest("sealed_last", "live_last")).alias("last_ts"), F.sum("n_bytes").alias("n_bytes"),
    )


def seam(a: Archive, columns: list[str]) -> DataFrame:
    """All rows of all streams: sealed segments by seq, then the live tail as one more; nothing twice."""
    sealed = a.payload.select(*KEYS, "seq", F.lit(True).alias("sealed"), *columns)
    after = stats.next_seqs(a.segments)
    tail = live(a.wal, a.segments).join(after, KEYS, "left").select(*KEYS, F.coalesce("next_seq", F.lit(0)).alias("seq"), F.lit(False).alias("sealed"), *columns)
    return sealed.unionByName(tail)


def probe(a: Archive, columns: list[str]) -> DataFrame:
    """For each stream one segment's rows: the first sealed one, or else the tail."""
    first = a.segments.groupBy(*KEYS).agg(F.min("seq").alias("seq"))
    sealed = a.payload.join(first, [*KEYS, "seq"], "left_semi").select(*KEYS, *columns)
    tail = live(a.wal, a.segments).join(first, KEYS, "left_anti").select(*KEYS, *columns)
    return sealed.unionByName(tail)


def stream_range(a: Archive, start: int, end: int, columns: list[str]) -> DataFrame:
    """Segments that meet the range, whole, and a stream's whole tail if any of its rows lies in the range."""
    sealed = payload_within(a.payload, overlapping(a.segments, start, end)).select(*KEYS, F.lit(True).alias("sealed"), *columns)
    tail = live(a.wal, a.segments)
    touched = tail.where(F.col("ts").between(start, end)).select(*KEYS).distinct()
    return sealed.unionByName(tail.join(touched, KEYS, "left_semi").select(*KEYS, F.lit(False).alias("sealed"), *columns))


def stream_indexes(a: Archive, tail_index) -> DataFrame:
    """Caller indexes in order, with one made by `tail_index`, an aggregate over the tail's rows, last."""
    sealed = a.segments.select(*KEYS, "seq").join(a.segment_indexes, [*KEYS, "seq"], "left").select(*KEYS, "seq", "bytes")
    tail = live(a.wal, a.segments).groupBy(*KEYS).agg(tail_index.alias("bytes")).join(stats.next_seqs(a.segments), KEYS, "left")
    return sealed.unionByName(tail.select(*KEYS, F.coalesce("next_seq", F.lit(0)).alias("seq"), "bytes"))


def contract(encoded: DataFrame, rows: DataFrame) -> DataFrame:
    """What an encoder's claim (keys, n_rows, first_ts, last_ts) is worth against the rows (keys, ts) it was given.

    It may drop a run at either end, never rows between: the rows within the
    span are as many as claimed and both ends are rows.
    """
    e = encoded.select(*KEYS, "n_rows", "first_ts", "last_ts")
    # What the encoder saw of a stream: one claim a stream, so the join adds no rows.
    within = rows.join(e, KEYS).where("ts BETWEEN first_ts AND last_ts")
    found = within.groupBy(*KEYS).agg(F.count("*").alias("_n"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    ok = (F.col("_n") == F.col("n_rows")) & (F.col("_lo") == F.col("first_ts")) & (F.col("_hi") == F.col("last_ts"))
    return e.join(found, KEYS, "left").select(*KEYS, "n_rows", "first_ts", "last_ts", F.coalesce(ok, F.lit(False)).alias("holds"))


def encoder_gate(sources: DataFrame, encoder: str | None) -> DataFrame:
    """Whether a source's recorded encoder version lets this one read it: differing versions don't, a missing one does."""
    has = F.col("metadata")["encoder"]
    return sources.select("id", has.alias("recorded"), (has.isNull() | F.lit(encoder is None) | (has == F.lit(encoder))).alias("readable"))
