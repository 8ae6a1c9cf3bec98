"""An archive derived from the driver's tables, in Spark and, with the same rules, in SQL.

Streams are event types of four sources; the sealed rows of a stream are its
first CAP-row runs, the rest is live. Every tenth sealed event also stays in the
tail, shadowed by its segment. Ranks are taken in time slices of SLICE, so no
stream is sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import ranked
from ..model import Archive

CAP = 20
SOURCES = 4
SLICE = 86_400_000_000  # a day, in microseconds
MINUTE = 60_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds of a zoneless timestamp, read as UTC in any session zone; a cast to an instant would move the hour that the zone skips in spring."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return F.unix_date(ts.cast("date")).cast("long") * SLICE + minutes.cast("long") * MINUTE + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % SOURCES + 1).alias("source_id"), F.col("event_type").alias("stream"), micros(F.col("ts")).alias("ts"),
        (F.col("event_id") % 7).alias("wall_offset"), "value", "props", "event_id",
    )


def placed_rows(spark: SparkSession, sf_dir: str, cap: int = CAP) -> DataFrame:
    """Base rows with seq and sealed."""
    r = ranked(base_rows(spark, sf_dir), ["source_id", "stream"], "ts", ["event_id"], SLICE)
    return r.withColumn("seq", F.expr(f"(rn - 1) div {cap}")).withColumn("sealed", F.col("rn") <= F.expr(f"(n_of_key div {cap}) * {cap}"))


def archive(spark: SparkSession, sf_dir: str) -> Archive:
    base = base_rows(spark, sf_dir)
    placed = placed_rows(spark, sf_dir)
    sealed = placed.where("sealed")
    payload = sealed.select("source_id", "stream", "seq", "ts", "wall_offset", "value", "props", "event_id")
    segments = sealed.groupBy("source_id", "stream", "seq").agg(
        F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum(F.octet_length("props") + F.lit(8)).alias("n_bytes"),
    )
    wal = placed.where("NOT sealed OR event_id % 10 = 0").select("source_id", "stream", "ts", "wall_offset", "value", "props", "event_id")
    indexes = segments.where("seq % 3 <> 1").select("source_id", "stream", "seq", F.concat(F.col("first_ts").cast("string"), F.lit("-"), F.col("last_ts").cast("string")).alias("bytes"))
    newest = F.max_by(F.struct("ts", "wall_offset"), "ts")
    clock = sealed.groupBy("source_id", "seq").agg(newest.alias("o")).select("source_id", F.col("o.ts").alias("ts"), F.col("o.wall_offset").alias("offset_ns"))
    signups = base.where("stream = 'signup'")
    caller = signups.select("source_id", F.when(F.col("event_id") % 2 == 0, "signup").otherwise("notes").alias("stream"), F.expr(f"ts - ts % {MINUTE}").alias("ts"), F.col("event_id").alias("ord"), F.col("props").alias("blob"))
    ids = base.groupBy("source_id").agg(F.min("ts").alias("anchor"))
    sources = ids.select(
        F.col("source_id").alias("id"),
        F.create_map(F.lit("host"), F.concat(F.lit("h"), F.col("source_id")), F.lit("arm"), F.when(F.col("source_id") % 2 == 0, "b").otherwise("a")).alias("labels"),
        F.create_map(F.lit("encoder"), F.when(F.col("source_id") == 3, "v2").otherwise("v1"), F.lit("unit"), F.lit("us")).alias("metadata"),
        (F.col("source_id") % 2 == 0).alias("complete"), F.col("anchor").alias("clock_anchor"),
        F.when(F.col("source_id") != 4, F.md5(F.col("source_id").cast("string"))).alias("uuid"),
        (F.col("source_id") * 10).alias("heartbeat"), F.lit(5_000_000_000).alias("heartbeat_interval"),
    )
    bounds = base.where("source_id <> 2").groupBy("source_id", F.col("stream").alias("name")).agg((F.max("ts") + 1000 * (F.col("source_id") - 2)).alias("ts"))
    bounds = bounds.select("source_id", F.lit(0).alias("kind"), "name", "ts").union(
        caller.where("source_id >= 3").groupBy("source_id", F.col("stream").alias("name")).agg((F.max("ts") + (F.col("source_id") - 3) * MINUTE).alias("ts")).select("source_id", F.lit(1).alias("kind"), "name", "ts")
    )
    return Archive(sources, segments, payload, wal, indexes, clock, caller, documents(spark, sf_dir), bounds)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions: a conversation's turns of one role, in order; every fifth is a deletion."""
    c = table(spark, sf_dir, "conversations")
    d = c.select(
        F.expr("turn * 4294967296 + conv_id").alias("id"), F.md5(F.concat_ws(":", "conv_id", "turn")).alias("uuid"), F.col("role").alias("kind"), F.col("conv_id").cast("string").alias("name"),
        F.when(F.expr("(turn + conv_id) % 5 <> 0"), "turn/1").alias("schema"), F.when(F.expr("(turn + conv_id) % 5 <> 0"), F.concat(F.lit('{"n":'), F.length("text").cast("string"), F.lit("}"))).alias("body"),
        (F.col("turn") * 1000 + F.col("conv_id")).alias("created"),
    )
    return d.withColumn("supersedes", F.lag("id").over(W.partitionBy("kind", "name").orderBy("id")))


#: The same relations for DuckDB: a prefix of common table expressions.
SQL = f"""WITH RECURSIVE
base AS (
  SELECT user_id % {SOURCES} + 1 AS source_id, event_type AS stream, epoch_us(ts) AS ts, event_id % 7 AS wall_offset, value, props, event_id FROM events),
placed AS (
  SELECT *, (rn - 1) // {CAP} AS seq, rn <= (n_of_key // {CAP}) * {CAP} AS sealed
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, stream ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY source_id, stream) AS n_of_key FROM base)),
payload AS (SELECT source_id, stream, seq, ts, wall_offset, value, props, event_id FROM placed WHERE sealed),
segments AS (
  SELECT source_id, stream, seq, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, sum(strlen(props) + 8)::BIGINT AS n_bytes
  FROM payload GROUP BY source_id, stream, seq),
wal AS (SELECT source_id, stream, ts, wall_offset, value, props, event_id FROM placed WHERE NOT sealed OR event_id % 10 = 0),
marks AS (SELECT source_id, stream, max(last_ts) AS mark FROM segments GROUP BY source_id, stream),
live AS (SELECT w.* FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE m.mark IS NULL OR w.ts > m.mark),
segment_indexes AS (SELECT source_id, stream, seq, first_ts::VARCHAR || '-' || last_ts::VARCHAR AS bytes FROM segments WHERE seq % 3 <> 1),
clock_offsets AS (SELECT source_id, max(ts) AS ts, arg_max(wall_offset, ts) AS offset_ns FROM payload GROUP BY source_id, seq),
caller_rows AS (
  SELECT source_id, CASE WHEN event_id % 2 = 0 THEN 'signup' ELSE 'notes' END AS stream, ts - ts % {MINUTE} AS ts, event_id AS ord, props AS blob
  FROM base WHERE stream = 'signup'),
sources AS (
  SELECT source_id AS id, 'h' || source_id AS host, CASE WHEN source_id % 2 = 0 THEN 'b' ELSE 'a' END AS arm, CASE WHEN source_id = 3 THEN 'v2' ELSE 'v1' END AS encoder,
         source_id % 2 = 0 AS complete, min(ts) AS clock_anchor, CASE WHEN source_id <> 4 THEN md5(source_id::VARCHAR) END AS uuid, source_id * 10 AS heartbeat, 5000000000 AS heartbeat_interval
  FROM base GROUP BY source_id),
bounds AS (
  SELECT source_id, 0 AS kind, stream AS name, max(ts) + 1000 * (source_id - 2) AS ts FROM base WHERE source_id <> 2 GROUP BY source_id, stream
  UNION ALL
  SELECT source_id, 1, stream, max(ts) + (source_id - 3) * {MINUTE} FROM caller_rows WHERE source_id >= 3 GROUP BY source_id, stream),
revisions AS (
  SELECT turn * 4294967296 + conv_id AS id, md5(conv_id || ':' || turn) AS uuid, role AS kind, conv_id::VARCHAR AS name,
         CASE WHEN (turn + conv_id) % 5 <> 0 THEN 'turn/1' END AS schema, CASE WHEN (turn + conv_id) % 5 <> 0 THEN '{{"n":' || length(text) || '}}' END AS body, turn * 1000 + conv_id AS created
  FROM conversations),
docs AS (SELECT *, lag(id) OVER (PARTITION BY kind, name ORDER BY id) AS supersedes FROM revisions)
"""
