"""The relations of an archive, as Spark schemas in DDL.

Time is always a long whose unit the caller chooses; it is never turned into a
timestamp, which would lose nanoseconds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

KEYS = ["source_id", "stream"]


SOURCES = "id BIGINT, labels MAP<STRING, STRING>, metadata MAP<STRING, STRING>, complete BOOLEAN, clock_anchor BIGINT, uuid STRING, heartbeat BIGINT, heartbeat_interval BIGINT"
SEGMENTS = "source_id BIGINT, stream STRING, seq BIGINT, n_rows BIGINT, first_ts BIGINT, last_ts BIGINT, n_bytes BIGINT"
SEGMENT_INDEXES = "source_id BIGINT, stream STRING, seq BIGINT, bytes BINARY"
WAL = "source_id BIGINT, stream STRING, ts BIGINT, wall_offset BIGINT, row BINARY"
CLOCK_OFFSETS = "source_id BIGINT, ts BIGINT, offset_ns BIGINT"
CALLER_ROWS = "source_id BIGINT, stream STRING, ts BIGINT, ord BIGINT, blob STRING"
DOCUMENTS = "id BIGINT, uuid STRING, kind STRING, name STRING, schema STRING, body STRING, created BIGINT, supersedes BIGINT"
BOUNDS = "source_id BIGINT, kind INT, name STRING, ts BIGINT"

STREAM_BOUND, CALLER_BOUND = 0, 1
STOPPED_AFTER_INTERVALS = 3


@dataclass(frozen=True)
class Archive:
    """One snapshot: every relation belongs to the same version."""

    sources: DataFrame
    segments: DataFrame  # the catalog, without payload
    payload: DataFrame  # rows of sealed segments, with source_id, stream, seq, ts
    wal: DataFrame
    segment_indexes: DataFrame
    clock_offsets: DataFrame
    caller_rows: DataFrame
    documents: DataFrame
    bounds: DataFrame
