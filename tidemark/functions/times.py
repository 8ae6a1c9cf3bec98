"""Arithmetic on long timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bucket(ts: Column, align: int | None) -> Column:
    """The aligned bucket of a timestamp, rounding down also below 0; null without a positive alignment."""
    if not align or align <= 0:
        return F.lit(None).cast("long")
    return F.call_function("div", ts - F.pmod(ts, F.lit(align)), F.lit(align))


def wall_clock(ts: Column, offset: Column) -> Column:
    return ts + offset


def ranked(df: DataFrame, keys: list[str], ts: str, ties: list[str], width: int, name: str = "rn") -> DataFrame:
    """row_number() in time order within keys, without one task for each key.

    Rows are numbered within slices of `width` time units; the slices' counts, a
    row for each key and slice, give what comes before a slice.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(ts) / width))
    own = F.row_number().over(W.partitionBy(*keys, "_slice").orderBy(ts, *ties))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(W.partitionBy(*keys))
    offsets = counts.select(*keys, "_slice", before.alias("_before"), total.alias("n_of_key"))
    out = sliced.withColumn("_own", own).join(offsets, [*keys, "_slice"])
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_slice", "_own", "_before")
