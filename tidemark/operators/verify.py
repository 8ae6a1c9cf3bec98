"""Integrity: one table of problems, and the counts of what was looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, Archive
from .scan import streams, with_mark


def _said(df: DataFrame, kind: str, detail: Column) -> DataFrame:
    where = [F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in (("source_id", "long"), ("stream", "string"), ("seq", "long"))]
    return df.select(F.lit(kind).alias("problem"), *where, detail.alias("detail"))


def problems(a: Archive) -> DataFrame:
    """problem, source_id, stream, seq, detail.

    Rows of sources that don't exist, indexes without a segment, segments that
    are empty or end before they begin, tail rows that their segments shadow,
    uuids that two sources share.
    """
    ids = a.sources.select(F.col("id").alias("source_id"))
    found = [
        _said(a.segments.join(ids, "source_id", "left_anti"), "orphan_segment", F.lit("no such source")),
        _said(a.wal.join(ids, "source_id", "left_anti").select(*KEYS).distinct(), "orphan_wal", F.lit("no such source")),
        _said(a.segment_indexes.join(a.segments, [*KEYS, "seq"], "left_anti"), "orphan_index", F.lit("no such segment")),
        _said(a.segments.where("first_ts > last_ts"), "inverted_segment", F.concat_ws("..", "first_ts", "last_ts")),
        _said(a.segments.where("n_rows = 0"), "empty_segment", F.lit("no rows")),
    ]
    shadowed = with_mark(a.wal, a.segments).groupBy(*KEYS).agg(F.count_if(F.col("ts") <= F.col("mark")).alias("n")).where("n > 0")
    found.append(_said(shadowed, "shadowed_wal", F.col("n").cast("string")))
    twice = a.sources.where("uuid IS NOT NULL").groupBy("uuid").agg(F.count("*").alias("n")).where("n > 1")
    found.append(_said(twice, "duplicate_uuid", F.concat_ws(" x", "uuid", "n")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def counts(a: Archive) -> DataFrame:
    """n_sources, n_streams, n_segments, n_wal, in one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(a.sources, "n_sources").crossJoin(one(streams(a.segments, a.wal), "n_streams")).crossJoin(one(a.segments, "n_segments")).crossJoin(one(a.wal, "n_wal"))  # one row each
