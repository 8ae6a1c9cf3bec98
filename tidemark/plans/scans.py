"""Scans, reads and aggregates as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import read, scan, stats
from .derive import SLICE, archive, base_rows, micros, table
from .registry import on_archive, query

ROW = ["ts", "wall_offset", "value", "event_id"]
START, END = 1_704_672_000_000_000, 1_705_276_800_000_000  # a week
K = "source_id, stream"


@query("s1_sniff", "SELECT page_id, CASE WHEN html = '' THEN NULL WHEN starts_with(html, '<!DOCTYPE') THEN 'doctype' WHEN starts_with(html, '<html') THEN 'html' WHEN substr(html, 2, 4) = 'head' THEN 'head' ELSE 'other' END AS kind FROM pages", prefix="")
def s1(spark, sf_dir):
    marks = [("doctype", 0, b"<!DOCTYPE"), ("html", 0, b"<html"), ("head", 1, b"head")]
    return table(spark, sf_dir, "pages").select("page_id", scan.sniff(F.col("html").cast("binary"), marks).alias("kind"))


@on_archive("s4_sources", "SELECT * FROM sources")
def s4(a):
    s = a.sources
    return s.select("id", F.col("labels")["host"].alias("host"), F.col("labels")["arm"].alias("arm"), F.col("metadata")["encoder"].alias("encoder"), "complete", "clock_anchor", "uuid", "heartbeat", "heartbeat_interval")


@on_archive("s5_source_metadata", "SELECT k AS key, CASE k WHEN 'encoder' THEN encoder ELSE 'us' END AS value FROM sources, unnest(['encoder', 'unit']) t(k) WHERE id = 2")
def s5(a):
    return a.sources.where("id = 2").select(F.explode("metadata"))


@on_archive("s6_streams", f"SELECT {K} FROM segments UNION SELECT {K} FROM wal")
def s6(a):
    return scan.streams(a.segments, a.wal)


@on_archive("s7_segment_meta", "SELECT * FROM segments WHERE source_id = 1 AND stream = 'view'")
def s7(a):
    return scan.of(a.segments, 1, "view").orderBy("seq")


@on_archive("s8_segment_payload", "SELECT * FROM payload WHERE source_id = 1 AND stream = 'click' AND seq = 1")
def s8(a):
    return scan.of(a.payload, 1, "click").where("seq = 1")


@on_archive("s9_range_scan", f"SELECT p.* FROM payload p JOIN segments s USING ({K}, seq) WHERE s.last_ts >= {START} AND s.first_ts <= {END}")
def s9(a):
    return scan.payload_within(a.payload, scan.overlapping(a.segments, START, END))


@on_archive("s10_wal", "SELECT * FROM wal")
def s10(a):
    return a.wal


@on_archive("s11_live_wal", "SELECT * FROM live")
def s11(a):
    return scan.live(a.wal, a.segments)


@on_archive("s12_segment_indexes", f"SELECT s.source_id, s.stream, s.seq, i.bytes FROM segments s LEFT JOIN segment_indexes i USING ({K}, seq)")
def s12(a):
    return scan.indexes(a.segments, a.segment_indexes)


@on_archive("s13_clock_offsets", "SELECT * FROM clock_offsets WHERE source_id = 3")
def s13(a):
    return a.clock_offsets.where("source_id = 3").orderBy("ts")


@on_archive("s14_caller_rows", f"SELECT * FROM caller_rows WHERE ts BETWEEN {START} AND {END}")
def s14(a):
    return scan.caller_range(a.caller_rows, START, END)


@on_archive("s15_caller_asof", f"SELECT {K}, r.ts AS ts, r.ord AS ord, r.blob AS blob FROM (SELECT {K}, arg_max({{'ts': ts, 'ord': ord, 'blob': blob}}, {{'ts': ts, 'ord': ord}}) AS r FROM caller_rows WHERE ts <= {END} AND blob LIKE '%7%' GROUP BY {K})")
def s15(a):
    return scan.caller_asof(a.caller_rows, END, F.col("blob").contains("7"))


NOTES = "(SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, ts ORDER BY ord DESC) AS n FROM caller_rows WHERE stream = 'notes') WHERE n = 1)"


@query("s15_asof_join", f"""SELECT r.source_id, r.ts, r.event_id, c.ts AS caller_ts, c.ord AS caller_ord, c.blob
FROM (SELECT source_id, ts, event_id FROM base WHERE stream = 'view') r ASOF LEFT JOIN {NOTES} c ON r.source_id = c.source_id AND r.ts >= c.ts""")
def s15_join(spark, sf_dir):
    a = archive(spark, sf_dir)
    views = base_rows(spark, sf_dir).where("stream = 'view'").select("source_id", F.lit("notes").alias("stream"), "ts", "event_id")
    return scan.asof_join(views, scan.of(a.caller_rows, stream="notes"), SLICE).drop("stream")


@on_archive("s16_caller_names", f"SELECT DISTINCT {K} FROM caller_rows UNION SELECT source_id, name FROM bounds WHERE kind = 1")
def s16(a):
    return scan.caller_names_or_bounded(a)


CATALOG = f"""
, sealed_spans AS (SELECT {K}, count(*) AS n_segments, sum(n_rows)::BIGINT AS sealed_rows, min(first_ts) AS sealed_first, max(last_ts) AS sealed_last, sum(n_bytes)::BIGINT AS n_bytes FROM segments GROUP BY {K}),
live_spans AS (SELECT {K}, count(*) AS live_rows, min(ts) AS live_first, max(ts) AS live_last FROM live GROUP BY {K}),
catalogued AS (
  SELECT {K}, coalesce(n_segments, 0) AS n_segments, coalesce(sealed_rows, 0) AS sealed_rows, sealed_first, sealed_last, coalesce(n_bytes, 0) AS n_bytes,
         coalesce(live_rows, 0) AS live_rows, live_first, live_last
  FROM sealed_spans FULL JOIN live_spans USING ({K}))
"""


@on_archive("catalog", CATALOG + "SELECT * FROM catalogued")
def r1(a):
    return read.catalog(a)


@on_archive("r2_describe", CATALOG + "SELECT count(DISTINCT source_id) AS n_sources, count(*) AS n_streams, sum(n_segments)::BIGINT AS n_segments, sum(sealed_rows + live_rows)::BIGINT AS n_rows, min(least(sealed_first, live_first)) AS first_ts, max(greatest(sealed_last, live_last)) AS last_ts, sum(n_bytes)::BIGINT AS n_bytes FROM catalogued")
def r2(a):
    return read.describe(a)


@on_archive("r3_rows_and_span", CATALOG + f"SELECT {K}, sealed_rows + live_rows AS n_rows, least(sealed_first, live_first) AS first_ts, greatest(sealed_last, live_last) AS last_ts FROM catalogued")
def r3(a):
    return read.rows_and_span(read.catalog(a))


@on_archive("r4_probe", f"SELECT {K}, ts, event_id FROM payload WHERE seq = 0 UNION ALL SELECT l.source_id, l.stream, l.ts, l.event_id FROM live l ANTI JOIN marks m ON l.source_id = m.source_id AND l.stream = m.stream")
def r4(a):
    return read.probe(a, ["ts", "event_id"])


LATE = 1_706_572_800_000_000  # the last day or two


@on_archive("r5_stream_range", f"""SELECT p.source_id, p.stream, true AS sealed, p.ts, p.event_id FROM payload p JOIN segments s USING ({K}, seq) WHERE s.last_ts >= {LATE} AND s.first_ts <= {LATE + SLICE}
UNION ALL SELECT source_id, stream, false, ts, event_id FROM live l WHERE EXISTS (SELECT 1 FROM live t WHERE t.source_id = l.source_id AND t.stream = l.stream AND t.ts BETWEEN {LATE} AND {LATE + SLICE})""")
def r5(a):
    return read.stream_range(a, LATE, LATE + SLICE, ["ts", "event_id"])


SEAM = f"SELECT {K}, seq, true AS sealed, ts, wall_offset, value, event_id FROM payload UNION ALL SELECT {K}, coalesce((SELECT max(seq) + 1 FROM segments s WHERE s.source_id = l.source_id AND s.stream = l.stream), 0), false, ts, wall_offset, value, event_id FROM live l"


@on_archive("r6_seam_read", SEAM)
def r6(a):
    return read.seam(a, ROW)


@on_archive("r7_stream_indexes", f"SELECT s.source_id, s.stream, s.seq, i.bytes FROM segments s LEFT JOIN segment_indexes i USING ({K}, seq) UNION ALL SELECT l.source_id, l.stream, coalesce(any_value(s.n), 0), min(ts)::VARCHAR || '-' || max(ts)::VARCHAR FROM live l LEFT JOIN (SELECT {K}, max(seq) + 1 AS n FROM segments GROUP BY {K}) s ON l.source_id = s.source_id AND l.stream = s.stream GROUP BY l.source_id, l.stream")
def r7(a):
    return read.stream_indexes(a, F.concat(F.min("ts").cast("string"), F.lit("-"), F.max("ts").cast("string")))


@on_archive("r9_contract", f""", claims AS (SELECT {K}, CASE WHEN source_id = 2 THEN max(ts) - 1 ELSE max(ts) END AS last_ts, min(ts) AS first_ts, count(*) - CASE WHEN source_id = 3 THEN 1 ELSE 0 END AS n_rows FROM live GROUP BY {K})
SELECT c.source_id, c.stream, c.n_rows, c.first_ts, c.last_ts,
       coalesce(count(l.ts) = c.n_rows AND min(l.ts) = c.first_ts AND max(l.ts) = c.last_ts, false) AS holds
FROM claims c LEFT JOIN live l ON c.source_id = l.source_id AND c.stream = l.stream AND l.ts BETWEEN c.first_ts AND c.last_ts GROUP BY c.source_id, c.stream, c.n_rows, c.first_ts, c.last_ts""")
def r9(a):
    tail = scan.live(a.wal, a.segments)
    wrong = lambda k: F.when(F.col("source_id") == k, 1).otherwise(0)
    claims = tail.groupBy("source_id", "stream").agg((F.max("ts") - wrong(2)).alias("last_ts"), F.min("ts").alias("first_ts"), (F.count("*") - wrong(3)).alias("n_rows"))
    return read.contract(claims, tail)


@on_archive("r10_encoder_gate", "SELECT id, encoder AS recorded, encoder IS NULL OR encoder = 'v1' AS readable FROM sources")
def r10(a):
    return read.encoder_gate(a.sources, "v1")


@on_archive("a1_total_rows", f"SELECT {K}, sum(n_rows)::BIGINT AS n_rows FROM segments GROUP BY {K}")
def a1(a):
    return stats.sealed_spans(a.segments).select("source_id", "stream", "n_rows")


@on_archive("a2_segment_span", f"SELECT {K}, count(*) AS n_segments, sum(n_rows)::BIGINT AS n_rows, min(first_ts) AS first_ts, max(last_ts) AS last_ts, sum(n_bytes)::BIGINT AS n_bytes FROM segments GROUP BY {K}")
def a2(a):
    return stats.sealed_spans(a.segments)


@on_archive("a3_live_span", f"SELECT {K}, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM live GROUP BY {K}")
def a3(a):
    return stats.live_spans(a)


CUT_BYTES = 4000


@on_archive("a4_size_cut", f"SELECT source_id, max(last_ts) AS cutoff FROM (SELECT *, sum(n_bytes) OVER (PARTITION BY source_id ORDER BY last_ts DESC RANGE UNBOUNDED PRECEDING) AS kept FROM segments) WHERE kept > {CUT_BYTES} GROUP BY source_id")
def a4(a):
    return stats.size_cut(a.segments, CUT_BYTES, SLICE)


@on_archive("a4_segment_sizes", "SELECT source_id, last_ts, n_bytes FROM segments")
def a4_sizes(a):
    return a.segments.select("source_id", "last_ts", "n_bytes")


@on_archive("a5_stream_bytes", f"SELECT {K}, sum(n_bytes)::BIGINT AS n_bytes FROM segments GROUP BY {K}")
def a5(a):
    return stats.sealed_spans(a.segments).select("source_id", "stream", "n_bytes")


@on_archive("a7_watermarks", "SELECT * FROM marks")
def a7(a):
    return scan.watermarks(a.segments)


@on_archive("a8_newest_rows", f"SELECT {K}, max(ts) AS newest FROM (SELECT {K}, ts FROM wal UNION ALL SELECT {K}, last_ts FROM segments UNION ALL SELECT source_id, name, ts FROM bounds WHERE kind = 0) GROUP BY {K}")
def a8(a):
    return stats.newest_rows(a)


FLOORS = f""", floors AS (
  SELECT coalesce(h.source_id, b.source_id) AS source_id, coalesce(h.stream, b.name) AS stream, held, bound, greatest(held, bound) AS floor, held IS NULL OR coalesce(bound > held, false) AS strict
  FROM (SELECT {K}, max(ts) AS held FROM caller_rows GROUP BY {K}) h
  FULL JOIN (SELECT source_id, name, ts AS bound FROM bounds WHERE kind = 1) b ON h.source_id = b.source_id AND h.stream = b.name)
"""


@on_archive("a9_caller_floors", FLOORS + "SELECT * FROM floors")
def a9(a):
    return stats.caller_floors(a)


@on_archive("a10_caller_positions", f"SELECT {K}, ts AS newest, count(*) AS n_at_newest FROM caller_rows c WHERE ts = (SELECT max(ts) FROM caller_rows m WHERE m.source_id = c.source_id AND m.stream = c.stream) GROUP BY {K}, ts")
def a10(a):
    return stats.caller_positions(a.caller_rows)


@on_archive("a11_newest_bounds", "SELECT source_id, max(ts) AS newest_bound FROM bounds WHERE kind = 0 GROUP BY source_id")
def a11(a):
    return stats.newest_bounds(a.bounds)


@on_archive("a12_next_seqs", f"SELECT {K}, max(seq) + 1 AS next_seq FROM segments GROUP BY {K}")
def a12(a):
    return stats.next_seqs(a.segments)


@on_archive("a13_source_spans", "SELECT source_id, min(first_ts) AS first_ts, max(last_ts) AS last_ts FROM (SELECT source_id, first_ts, last_ts FROM segments UNION ALL SELECT source_id, ts, ts FROM live) GROUP BY source_id")
def a13(a):
    return stats.source_spans(a)


@on_archive("a14_oldest_rows", "SELECT source_id, min(ts) AS oldest FROM (SELECT source_id, first_ts AS ts FROM segments UNION ALL SELECT source_id, ts FROM wal) GROUP BY source_id")
def a14(a):
    return stats.oldest_rows(a)


@on_archive("a15_total_wal_rows", f"SELECT {K}, count(*) AS n FROM wal GROUP BY {K}")
def a15(a):
    return a.wal.groupBy("source_id", "stream").agg(F.count("*").alias("n"))


HOUR = 3_600_000_000


@query("a16_liveness", f""", seen AS (
  SELECT user_id % 8 AS source_id, epoch_us(ts) AS seen_at, CASE WHEN user_id % 8 = 5 THEN NULL ELSE event_id // 97 END AS heartbeat, user_id % 8 = 6 AND event_id > 500 AS complete, CASE WHEN user_id % 8 = 7 THEN 0 ELSE {HOUR} END AS heartbeat_interval FROM events),
moved AS (SELECT *, CASE WHEN heartbeat <> coalesce(lag(heartbeat) OVER (PARTITION BY source_id ORDER BY seen_at), heartbeat - 1) THEN seen_at END AS changed FROM seen),
since AS (SELECT *, last_value(changed IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY seen_at ROWS UNBOUNDED PRECEDING) AS since FROM moved)
SELECT source_id, seen_at, CASE WHEN complete THEN 'complete' WHEN heartbeat IS NULL OR heartbeat_interval IS NULL OR heartbeat_interval <= 0 THEN 'unknown' WHEN seen_at - since >= 3 * heartbeat_interval THEN 'stopped' ELSE 'live' END AS state FROM since""")
def a16(spark, sf_dir):
    e, source = table(spark, sf_dir, "events"), F.col("user_id") % 8
    seen = e.select(source.alias("source_id"), micros(F.col("ts")).alias("seen_at"), F.when(source != 5, F.expr("event_id div 97")).alias("heartbeat"), ((source == 6) & (F.col("event_id") > 500)).alias("complete"), F.when(source == 7, 0).otherwise(HOUR).cast("long").alias("heartbeat_interval"))
    return stats.liveness(seen)
