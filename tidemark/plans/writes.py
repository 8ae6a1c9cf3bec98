"""Ingest, sealing and retention as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes, times
from ..operators import ingest, retention, scan, seal, stats
from .derive import SLICE, archive, base_rows, micros, table
from .registry import on_archive, query

K = "source_id, stream"
HOUR = 3_600_000_000

TICKS = f""", ticks AS (
  SELECT source_id, stream, event_id // 50 AS tick, ts - ts % {HOUR} - CASE WHEN event_id % 13 = 0 THEN 3 * {SLICE} ELSE 0 END AS ts, event_id AS ord FROM base),
floor_of AS (SELECT source_id, min(ts) + 3 * {SLICE} AS floor FROM base WHERE source_id = 4 GROUP BY source_id),
low AS (SELECT t.source_id, t.tick FROM ticks t JOIN floor_of f ON t.source_id = f.source_id GROUP BY t.source_id, t.tick, f.floor HAVING min(t.ts) <= f.floor),
started AS (SELECT source_id, stream, min(ts) + {SLICE} AS newest FROM base WHERE stream = 'error' GROUP BY source_id, stream),
standing AS (SELECT t.* FROM ticks t ANTI JOIN low l ON t.source_id = l.source_id AND t.tick = l.tick),
bounded AS (
  SELECT s.*, greatest(max(s.ts) OVER (PARTITION BY s.source_id, s.stream ORDER BY s.tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b.newest) AS bound,
         row_number() OVER (PARTITION BY s.source_id, s.stream, s.tick, s.ts ORDER BY s.ord) AS nth
  FROM standing s LEFT JOIN started b ON s.source_id = b.source_id AND s.stream = b.stream),
judged AS (
  SELECT source_id, stream, tick, ts, ord, CASE WHEN ts <= bound THEN 'late' WHEN nth > 1 THEN 'repeated' ELSE 'accepted' END AS outcome FROM bounded
  UNION ALL SELECT t.*, 'below_floor' FROM ticks t JOIN low l ON t.source_id = l.source_id AND t.tick = l.tick)
"""


def ticks(spark, sf_dir):
    b = base_rows(spark, sf_dir)
    late = F.when(F.col("event_id") % 13 == 0, 3 * SLICE).otherwise(0)
    rows = b.select("source_id", "stream", F.expr("event_id div 50").alias("tick"), (F.expr(f"ts - ts % {HOUR}") - late).alias("ts"), F.col("event_id").alias("ord"))
    floors = b.where("source_id = 4").groupBy("source_id").agg((F.min("ts") + 3 * SLICE).alias("floor"))
    newest = b.where("stream = 'error'").groupBy("source_id", "stream").agg((F.min("ts") + SLICE).alias("newest"))
    return rows, newest, floors


@query("w4_admission", TICKS + f"SELECT {K}, tick, ts, ord, outcome FROM judged")
def w4(spark, sf_dir):
    return ingest.admit(*ticks(spark, sf_dir))


@query("w5_dropped", TICKS + "SELECT source_id, count(*) FILTER (outcome IN ('late', 'repeated')) AS n_dropped FROM judged GROUP BY source_id")
def w5(spark, sf_dir):
    return ingest.dropped(ingest.admit(*ticks(spark, sf_dir)))


@query("w4_replica_admission", TICKS + f""", even AS (SELECT source_id, stream, tick, ts + CASE WHEN ord % 13 = 0 THEN 3 * {SLICE} ELSE 0 END AS ts, ord FROM ticks),
plain AS (
  SELECT t.*, greatest(max(t.ts) OVER (PARTITION BY t.source_id, t.stream ORDER BY t.tick RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), b.newest) AS bound,
         row_number() OVER (PARTITION BY t.source_id, t.stream, t.tick, t.ts ORDER BY t.ord) AS nth
  FROM even t LEFT JOIN started b ON t.source_id = b.source_id AND t.stream = b.stream),
stop AS (SELECT source_id, min(tick) AS stop FROM plain WHERE ts <= bound OR nth > 1 GROUP BY source_id)
SELECT p.source_id, p.stream, p.tick, p.ts, p.ord, CASE WHEN s.stop IS NULL OR p.tick < s.stop THEN 'accepted' ELSE 'poisoned' END AS outcome FROM plain p LEFT JOIN stop s ON p.source_id = s.source_id""")
def w4_replica(spark, sf_dir):
    rows, newest, _ = ticks(spark, sf_dir)
    even = rows.withColumn("ts", F.col("ts") + F.when(F.col("ord") % 13 == 0, 3 * SLICE).otherwise(0))
    return ingest.admit_replica(even, newest)


@on_archive("w6_floors", "SELECT source_id, max(ts) AS floor FROM (SELECT source_id, ts FROM wal UNION ALL SELECT source_id, last_ts FROM segments UNION ALL SELECT source_id, ts FROM bounds WHERE kind = 0) GROUP BY source_id")
def w6(a):
    return ingest.floors_of(a)


@query("w2_add_sources", """, new AS (SELECT s_suppkey AS ord, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE md5((s_suppkey % 7)::VARCHAR) END AS uuid FROM supplier)
SELECT ord, uuid, uuid IS NULL OR (uuid NOT IN (SELECT uuid FROM sources WHERE uuid IS NOT NULL) AND row_number() OVER (PARTITION BY uuid ORDER BY ord) = 1) AS accepted FROM new""")
def w2(spark, sf_dir):
    new = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.when(F.col("s_suppkey") % 5 != 0, F.md5((F.col("s_suppkey") % 7).cast("string"))).alias("uuid"))
    return ingest.add_sources(archive(spark, sf_dir).sources, new)


@on_archive("w3_resume", f""", floors AS (SELECT source_id, max(ts) AS floor FROM (SELECT source_id, ts FROM wal UNION ALL SELECT source_id, last_ts FROM segments UNION ALL SELECT source_id, ts FROM bounds WHERE kind = 0) GROUP BY source_id)
SELECT id, clock_anchor + id * 9 * {SLICE} AS anchor, floor, CASE WHEN clock_anchor + id * 9 * {SLICE} <= floor THEN 'timeline_backwards' ELSE 'resumed' END AS outcome FROM sources JOIN floors ON id = source_id""")
def w3(a):
    requests = a.sources.select("id", (F.col("clock_anchor") + F.col("id") * 9 * SLICE).alias("anchor"))
    return ingest.resume(a.sources, ingest.floors_of(a), requests)


SEALED = f""", parted AS (
  SELECT l.*, coalesce(m.n, 0) + (row_number() OVER (PARTITION BY l.source_id, l.stream ORDER BY l.ts) - 1) // CAP AS part
  FROM live l LEFT JOIN (SELECT {K}, max(seq) + 1 AS n FROM segments GROUP BY {K}) m ON l.source_id = m.source_id AND l.stream = m.stream)
"""


def parts(a, cap):
    return seal.sealed_parts(scan.live(a.wal, a.segments), stats.next_seqs(a.segments), cap, SLICE)


@on_archive("w7_seal", SEALED.replace("CAP", "1000000") + f"SELECT {K}, part AS seq, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM parted GROUP BY {K}, part")
def w7(a):
    return seal.segments_of(parts(a, 1_000_000))


@on_archive("w7_observations", "SELECT source_id, o.ts AS ts, o.wall_offset AS offset_ns FROM (SELECT source_id, arg_max({'ts': ts, 'wall_offset': wall_offset}, {'ts': ts, 'stream': stream}) AS o FROM live GROUP BY source_id)")
def w7_observations(a):
    return seal.observations(parts(a, 1_000_000))


@on_archive("w8_seal_capped", SEALED.replace("CAP", "4") + f"SELECT {K}, part AS seq, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM parted GROUP BY {K}, part")
def w8(a):
    return seal.segments_of(parts(a, 4))


@on_archive("w8_tiled", SEALED.replace("CAP", "6") + f""", edges AS (SELECT {K}, part, min(ts) AS f, max(ts) AS l FROM parted GROUP BY {K}, part),
kept AS (SELECT {K}, part, count(*) AS n, min(ts) AS kf, max(ts) AS kl FROM parted WHERE event_id % 7 <> 0 GROUP BY {K}, part),
span AS (SELECT {K}, min(part) AS lo, max(part) AS hi FROM edges GROUP BY {K}),
ok AS (
  SELECT e.source_id, e.stream, e.part, k.n, kf, kl, lo, lo = hi OR (k.n IS NOT NULL AND (e.part = lo OR coalesce(kf = f, false)) AND (e.part = hi OR coalesce(kl = l, false))) AS good
  FROM edges e LEFT JOIN kept k USING ({K}, part) JOIN span s USING ({K})),
fall AS (SELECT {K}, bool_or(NOT good) AS fallback FROM ok GROUP BY {K})
SELECT o.source_id, o.stream, CASE WHEN fallback THEN lo ELSE part END AS seq, fallback, sum(n)::BIGINT AS n_rows, min(kf) AS first_ts, max(kl) AS last_ts
FROM ok o JOIN fall USING ({K}) GROUP BY o.source_id, o.stream, CASE WHEN fallback THEN lo ELSE part END, fallback HAVING sum(n) > 0""")
def w8_tiled(a):
    p = parts(a, 6)
    return seal.tiled(p, p.where("event_id % 7 <> 0"))


POLICY = seal.SealPolicy(max_bytes=160, max_rows=12, max_age=4 * SLICE, align=7 * SLICE)


@query("p2_due", f""", lines AS (SELECT {K}, ts, strlen(props)::BIGINT AS n_bytes, row_number() OVER (PARTITION BY {K} ORDER BY ts) AS rn, ts // {POLICY.align} AS bucket FROM base),
cut AS (
  SELECT {K}, rn, ts, n_bytes, bucket, 0::BIGINT AS seq, 1 AS n, n_bytes AS size, ts AS opened FROM lines WHERE rn = 1
  UNION ALL
  SELECT x.source_id, x.stream, x.rn, x.ts, x.n_bytes, x.bucket, c.seq + e.ended::INT, CASE WHEN e.ended THEN 1 ELSE c.n + 1 END, CASE WHEN e.ended THEN x.n_bytes ELSE c.size + x.n_bytes END, CASE WHEN e.ended THEN x.ts ELSE c.opened END
  FROM cut c JOIN lines x ON x.source_id = c.source_id AND x.stream = c.stream AND x.rn = c.rn + 1,
  LATERAL (SELECT c.n >= {POLICY.max_rows} OR c.size >= {POLICY.max_bytes} OR c.ts - c.opened >= {POLICY.max_age} OR x.bucket <> c.bucket AS ended) e)
SELECT {K}, ts, n_bytes, seq FROM cut""")
def p2(spark, sf_dir):
    rows = base_rows(spark, sf_dir).select("source_id", "stream", "ts", F.octet_length("props").cast("long").alias("n_bytes"))
    return seal.due(rows, POLICY)


@query("p3_aligned_buckets", f"SELECT event_id, ts - epoch_us(TIMESTAMP '2024-01-16') AS ts, (ts - epoch_us(TIMESTAMP '2024-01-16') - (((ts - epoch_us(TIMESTAMP '2024-01-16')) % {7 * HOUR}) + {7 * HOUR}) % {7 * HOUR}) // {7 * HOUR} AS bucket FROM base")
def p3(spark, sf_dir):
    ts = F.col("ts") - micros(F.lit("2024-01-16").cast("timestamp_ntz"))
    return base_rows(spark, sf_dir).select("event_id", ts.alias("ts"), times.bucket(ts, 7 * HOUR).alias("bucket"))


@on_archive("p4_stagger", f""", keyed AS (SELECT DISTINCT s.id, g.stream, g.stream || chr(255) || 'arm=' || s.arm || chr(1) || 'host=' || s.host AS key FROM sources s JOIN (SELECT DISTINCT {K} FROM segments) g ON s.id = g.source_id),
codes AS (SELECT id, stream, [37] || flatten(list_transform(string_split(key, ''), lambda c: [CASE WHEN unicode(c) = 255 THEN 255 ELSE unicode(c) END, unicode(c) // 64])) AS parts FROM keyed)
SELECT id, stream, list_reduce(parts, lambda h, p: (xor(h, p) * 51) % 64)::INT AS bucket FROM codes""")
def p4(a):
    streams = a.segments.select("source_id", "stream").distinct().withColumnRenamed("source_id", "id")
    return streams.join(a.sources, "id").select("id", "stream", hashes.stagger("stream", hashes.source_key(F.col("labels"))).alias("bucket"))


@on_archive("w10_adopt", f""", offered AS (
  SELECT m.source_id, m.stream, CASE WHEN m.stream = 'click' AND m.source_id = 1 THEN 0 ELSE 5 END AS n_rows,
         mark + CASE m.stream WHEN 'view' THEN -2000 WHEN 'error' THEN -1000 ELSE 1 END AS first_ts, mark + CASE m.stream WHEN 'view' THEN -1000 WHEN 'signup' THEN {30 * SLICE} ELSE 1000 END AS last_ts FROM marks m),
oldest AS (SELECT {K}, min(ts) AS oldest FROM live GROUP BY {K})
SELECT o.*, CASE WHEN n_rows = 0 OR first_ts > last_ts THEN 'invalid' WHEN last_ts <= mark THEN 'held' WHEN first_ts <= mark THEN 'straddles' WHEN last_ts >= oldest THEN 'covers_live' ELSE 'adopted' END AS outcome
FROM offered o JOIN marks m ON o.source_id = m.source_id AND o.stream = m.stream LEFT JOIN oldest l ON o.source_id = l.source_id AND o.stream = l.stream""")
def w10(a):
    s, m = F.col("stream"), F.col("mark")
    marks = scan.watermarks(a.segments)
    offered = marks.select(
        "source_id", "stream", F.when((s == "click") & (F.col("source_id") == 1), 0).otherwise(5).alias("n_rows"),
        (m + F.when(s == "view", -2000).when(s == "error", -1000).otherwise(1)).alias("first_ts"), (m + F.when(s == "view", -1000).when(s == "signup", 30 * SLICE).otherwise(1000)).alias("last_ts"),
    )
    return seal.adoption(offered, marks, scan.live(a.wal, a.segments))


GROUP = f""", offers AS (
  SELECT m.source_id, m.stream, o AS ord, mark + (o - 1) * {SLICE} + CASE WHEN m.stream = 'error' AND o = 2 THEN -5 ELSE 0 END AS after,
         CASE WHEN m.stream = 'click' AND m.source_id = 2 AND o = 3 THEN 0 ELSE 5 END AS n_rows, mark + (o - 1) * {SLICE} + {SLICE // 2} AS first_ts, mark + o * {SLICE} AS last_ts
  FROM marks m, unnest([1, 2, 3]) t(o)),
lined AS (
  SELECT o.*, coalesce(lag(last_ts) OVER w, mark) AS sealed, max(last_ts) OVER (PARTITION BY o.source_id, o.stream ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
  FROM offers o JOIN marks m ON o.source_id = m.source_id AND o.stream = m.stream WINDOW w AS (PARTITION BY o.source_id, o.stream ORDER BY ord)),
counted AS (
  SELECT l.*, (SELECT count(*) FROM live v WHERE v.source_id = l.source_id AND v.stream = l.stream AND (covered IS NULL OR v.ts > covered) AND v.ts <= after) AS below,
         (SELECT count(*) FROM live v WHERE v.source_id = l.source_id AND v.stream = l.stream AND (covered IS NULL OR v.ts > covered) AND v.ts > after AND v.ts < first_ts) AS pruned
  FROM lined l),
problems AS (SELECT *, CASE WHEN n_rows = 0 OR first_ts > last_ts OR last_ts <= after THEN 'invalid' WHEN sealed > after OR first_ts <= sealed THEN 'overlaps' WHEN below > 0 THEN 'live_below' END AS problem FROM counted),
firsts AS (SELECT {K}, arg_min(problem, ord) FILTER (problem IS NOT NULL) AS problem, sum(pruned)::BIGINT AS pruned FROM problems GROUP BY {K})
SELECT {K}, coalesce(problem, 'adopted') AS outcome, CASE WHEN problem IS NULL THEN pruned ELSE 0 END AS pruned FROM firsts"""


@on_archive("w11_adopt_group", GROUP)
def w11(a):
    marks = scan.watermarks(a.segments)
    o = marks.withColumn("ord", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    base = F.col("mark") + (F.col("ord") - 1) * F.lit(SLICE)
    parts = o.select(
        "source_id", "stream", "ord", (base + F.when((F.col("stream") == "error") & (F.col("ord") == 2), -5).otherwise(0)).alias("after"),
        F.when((F.col("stream") == "click") & (F.col("source_id") == 2) & (F.col("ord") == 3), 0).otherwise(5).alias("n_rows"), (base + SLICE // 2).alias("first_ts"), (base + SLICE).alias("last_ts"),
    )
    return seal.group_adoption(parts, marks, scan.live(a.wal, a.segments))


@on_archive("w12_sync", f""", points AS (SELECT source_id, stream, CASE WHEN source_id = 1 THEN mark ELSE min(s.last_ts) + (source_id - 2) * {2 * SLICE} END AS at_ FROM segments s JOIN marks m USING ({K}) GROUP BY source_id, stream, mark),
cut AS (
  SELECT p.source_id, p.stream, at_, bool_or(first_ts <= at_ AND at_ < last_ts) AS inside, max(last_ts) AS mark, sum(CASE WHEN first_ts > at_ THEN n_rows ELSE 0 END)::BIGINT AS gone
  FROM points p JOIN segments s ON p.source_id = s.source_id AND p.stream = s.stream GROUP BY p.source_id, p.stream, at_),
tails AS (
  SELECT c.source_id, c.stream, count(*) FILTER (w.ts > mark AND w.ts <= at_) AS sealed, count(*) FILTER (w.ts > mark AND w.ts > at_) AS cut_, max(w.ts) AS newest
  FROM cut c JOIN wal w ON c.source_id = w.source_id AND c.stream = w.stream GROUP BY c.source_id, c.stream)
SELECT c.source_id, c.stream, at_ AS "at", CASE WHEN inside THEN 'inside_segment' ELSE 'synced' END AS outcome, CASE WHEN inside THEN 0 ELSE coalesce(sealed, 0) END AS sealed,
       CASE WHEN inside THEN 0 ELSE gone + coalesce(cut_, 0) END AS replaced, CASE WHEN NOT inside AND greatest(newest, mark) > at_ THEN greatest(newest, mark) END AS bound
FROM cut c LEFT JOIN tails t ON c.source_id = t.source_id AND c.stream = t.stream""")
def w12(a):
    points = a.segments.groupBy("source_id", "stream").agg(F.min("last_ts").alias("lo"), F.max("last_ts").alias("hi"))
    points = points.select("source_id", "stream", F.when(F.col("source_id") == 1, F.col("hi")).otherwise(F.col("lo") + (F.col("source_id") - 2) * 2 * SLICE).alias("at"))
    return seal.sync(a.segments, a.wal, points)


@on_archive("w13_caller_rows", f""", floors AS (
  SELECT coalesce(h.source_id, b.source_id) AS source_id, coalesce(h.stream, b.name) AS stream, greatest(held, bound) AS floor, held IS NULL OR coalesce(bound > held, false) AS strict
  FROM (SELECT {K}, max(ts) AS held FROM caller_rows GROUP BY {K}) h FULL JOIN (SELECT source_id, name, ts AS bound FROM bounds WHERE kind = 1) b ON h.source_id = b.source_id AND h.stream = b.name),
offered AS (
  SELECT source_id, CASE WHEN ord % 10 = 0 THEN 'fresh' ELSE stream END AS stream, CASE WHEN ord % 3 = 0 THEN ts ELSE floor_ + (ord % 2) * 60000000 END AS ts, ord
  FROM (SELECT c.*, f.floor AS floor_ FROM caller_rows c JOIN floors f USING ({K})))
SELECT o.*, floor IS NULL OR ts > floor OR (NOT strict AND ts = floor) AS accepted FROM offered o LEFT JOIN floors f ON o.source_id = f.source_id AND o.stream = f.stream""")
def w13(a):
    floors = stats.caller_floors(a)
    c = a.caller_rows.join(floors.select("source_id", "stream", "floor"), ["source_id", "stream"])
    offered = c.select("source_id", F.when(F.col("ord") % 10 == 0, "fresh").otherwise(F.col("stream")).alias("stream"), F.when(F.col("ord") % 3 == 0, F.col("ts")).otherwise(F.col("floor") + (F.col("ord") % 2) * 60_000_000).alias("ts"), "ord")
    return ingest.admit_caller_rows(offered, floors)


@on_archive("w14_clock_offsets", """, new AS (SELECT source_id, ts - CASE WHEN offset_ns % 2 = 0 THEN 0 ELSE 1 END AS ts, offset_ns + o AS offset_ns, o AS ord FROM clock_offsets, unnest([2, 1]) t(o))
SELECT source_id, ts, arg_min(offset_ns, ord) AS offset_ns FROM new n WHERE NOT EXISTS (SELECT 1 FROM clock_offsets c WHERE c.source_id = n.source_id AND c.ts = n.ts) GROUP BY source_id, ts""")
def w14(a):
    new = a.clock_offsets.withColumn("ord", F.explode(F.array(F.lit(2), F.lit(1)))).select("source_id", (F.col("ts") - F.when(F.col("offset_ns") % 2 == 0, 0).otherwise(1)).alias("ts"), (F.col("offset_ns") + F.col("ord")).alias("offset_ns"), "ord")
    return ingest.add_clock_offsets(a.clock_offsets, new)


@on_archive("w15_metadata_patch", "SELECT id, k AS key, CASE k WHEN 'encoder' THEN 'v3' WHEN 'unit' THEN 'us' ELSE 'x' || id END AS value FROM sources, unnest(['encoder', 'unit', 'note']) t(k)")
def w15(a):
    patch = F.create_map(F.lit("encoder"), F.lit("v3"), F.lit("note"), F.concat(F.lit("x"), F.col("id")))
    return a.sources.select("id", F.explode(ingest.patched(F.col("metadata"), patch)))


@on_archive("w16_finalize", "SELECT id, complete OR id = 3 AS complete FROM sources")
def w16(a):
    return ingest.finalize(a.sources, 3).select("id", "complete")


CUTOFF = 1_705_276_800_000_000
REPORT = """, gone_segments AS (SELECT count(*) AS segments FROM segments WHERE SCOPE AND last_ts < CUTOFF),
tail AS (SELECT w.*, mark IS NULL OR w.ts > mark AS alive FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE w.SCOPE),
rows_ AS (SELECT count(*) FILTER (NOT alive AND ts < CUTOFF) AS wal_rows, count(*) FILTER (alive AND ts < CUTOFF) AS kept_live_rows FROM tail)
""".replace("CUTOFF", str(CUTOFF))


@on_archive("d1_evict_report", REPORT.replace("SCOPE", "source_id = 1") + f"SELECT segments, wal_rows, kept_live_rows, (SELECT count(*) FROM caller_rows WHERE source_id = 1 AND ts < {CUTOFF}) AS caller_rows FROM gone_segments, rows_")
def d1_report(a):
    return retention.evict(a, 1, CUTOFF).report


@on_archive("d1_evict_rows", f"SELECT source_id, stream, seq, n_rows FROM segments WHERE NOT (source_id = 1 AND last_ts < {CUTOFF})")
def d1_rows(a):
    return retention.evict(a, 1, CUTOFF).archive.segments.select("source_id", "stream", "seq", "n_rows")


@on_archive("d1_evict_wal", f"SELECT w.* FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE NOT (w.source_id = 1 AND w.ts < {CUTOFF} AND mark IS NOT NULL AND w.ts <= mark)")
def d1_wal(a):
    return retention.evict(a, 1, CUTOFF).archive.wal


LAST = 1_706_745_600_000_000  # after every event


@on_archive("d2_evict_streams", REPORT.replace(str(CUTOFF), str(LAST)).replace("w.SCOPE", "w.source_id = 3 AND w.stream IN ('view', 'notes')").replace("SCOPE", "source_id = 3 AND stream IN ('view', 'notes')")
            + f"SELECT segments, wal_rows, kept_live_rows, (SELECT count(*) FROM caller_rows WHERE source_id = 3 AND stream IN ('view', 'notes') AND ts < {LAST}) AS caller_rows FROM gone_segments, rows_")
def d2(a):
    return retention.evict(a, 3, LAST, streams=F.col("stream").isin("view", "notes")).report


@on_archive("d2_evict_clock", f""", left_ AS (SELECT min(ts) AS oldest FROM (SELECT first_ts AS ts FROM segments WHERE source_id = 3 AND NOT (stream IN ('view', 'error') AND last_ts < {CUTOFF}) UNION ALL
  SELECT w.ts FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE w.source_id = 3 AND NOT (w.stream IN ('view', 'error') AND w.ts < {CUTOFF} AND mark IS NOT NULL AND w.ts <= mark)))
SELECT * FROM clock_offsets WHERE NOT (source_id = 3 AND ts < (SELECT coalesce(oldest, {CUTOFF}) FROM left_))""")
def d2_clock(a):
    return retention.evict(a, 3, CUTOFF, streams=F.col("stream").isin("view", "error")).archive.clock_offsets


@on_archive("d3_evict_floors", f""", left_ AS (SELECT stream, min(ts) AS oldest FROM (SELECT stream, first_ts AS ts FROM segments WHERE source_id = 4 AND last_ts >= {CUTOFF} UNION ALL
  SELECT w.stream, w.ts FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE w.source_id = 4 AND NOT (w.ts < {CUTOFF} AND mark IS NOT NULL AND w.ts <= mark)) GROUP BY stream)
SELECT c.* FROM caller_rows c LEFT JOIN left_ l ON c.stream = l.stream WHERE NOT (c.source_id = 4 AND c.ts < least(coalesce(oldest, 0) - {SLICE}, {CUTOFF}))""")
def d3(a):
    return retention.evict(a, 4, CUTOFF, floor=F.coalesce("oldest", F.lit(0)) - SLICE).archive.caller_rows


@on_archive("d4_discard_live", "SELECT w.source_id, w.stream, w.ts, w.event_id FROM wal w LEFT JOIN marks m ON w.source_id = m.source_id AND w.stream = m.stream WHERE NOT (w.source_id IN (1, 2) AND (mark IS NULL OR w.ts > mark))")
def d4(a):
    return retention.discard_live(a, F.col("source_id").isin(1, 2)).wal.select("source_id", "stream", "ts", "event_id")


@on_archive("d5_prune", f"SELECT * FROM wal WHERE NOT (source_id = 2 AND stream = 'error' AND ts <= {CUTOFF})")
def d5(a):
    return retention.prune(a, 2, "error", CUTOFF).wal


@on_archive("d6_delete_segments", f"SELECT i.* FROM segment_indexes i WHERE i.seq % 2 = 1")
def d6(a):
    return retention.delete_segments(a, a.segments.where("seq % 2 = 0").select("source_id", "stream", "seq")).segment_indexes


@on_archive("d7_bounds", f""", tops AS (SELECT source_id, stream, max(ts) AS ts FROM (SELECT {K}, ts FROM wal UNION ALL SELECT {K}, last_ts FROM segments) WHERE source_id = 2 GROUP BY {K} HAVING max(ts) < {LAST}),
names AS (SELECT source_id, stream, max(ts) AS ts FROM caller_rows WHERE source_id = 2 GROUP BY {K} HAVING max(ts) < {LAST})
SELECT source_id, kind, name, max(ts) AS ts FROM (SELECT * FROM bounds UNION ALL SELECT source_id, 0, stream, ts FROM tops UNION ALL SELECT source_id, 1, stream, ts FROM names) GROUP BY source_id, kind, name""")
def d7(a):
    return retention.evict(a, 2, LAST).archive.bounds


@on_archive("w7_sealed_archive", f"""SELECT source_id, stream, count(*) AS n_segments, sum(n_rows)::BIGINT AS n_rows, max(last_ts) AS last_ts FROM (
  SELECT {K}, n_rows, last_ts FROM segments
  UNION ALL SELECT {K}, count(*), max(ts) FROM (SELECT *, (row_number() OVER (PARTITION BY {K} ORDER BY ts) - 1) // 4 AS part FROM live) GROUP BY {K}, part) GROUP BY {K}""")
def w7_archive(a):
    return seal.sealed(a, 4, SLICE).segments.groupBy("source_id", "stream").agg(F.count("*").alias("n_segments"), F.sum("n_rows").alias("n_rows"), F.max("last_ts").alias("last_ts"))


@on_archive("w7_sealed_clock", "SELECT * FROM clock_offsets UNION ALL SELECT source_id, o.ts, o.wall_offset FROM (SELECT source_id, arg_max({'ts': ts, 'wall_offset': wall_offset}, {'ts': ts, 'stream': stream}) AS o FROM live GROUP BY source_id) l WHERE NOT EXISTS (SELECT 1 FROM clock_offsets c WHERE c.source_id = l.source_id AND c.ts = l.o.ts)")
def w7_clock(a):
    return seal.sealed(a, 4, SLICE).clock_offsets


@on_archive("w10_adopted_archive", f"""SELECT source_id, stream, max(seq) AS seq, max(last_ts) AS last_ts, sum(n_rows)::BIGINT AS n_rows FROM (
  SELECT {K}, seq, last_ts, n_rows FROM segments
  UNION ALL SELECT m.source_id, m.stream, (SELECT max(seq) + 1 FROM segments s WHERE s.source_id = m.source_id AND s.stream = m.stream), mark + 2, 1
  FROM marks m WHERE m.stream <> 'view' AND NOT EXISTS (SELECT 1 FROM live l WHERE l.source_id = m.source_id AND l.stream = m.stream AND l.ts <= mark + 2)) GROUP BY {K}""")
def w10_archive(a):
    marks = scan.watermarks(a.segments).where("stream <> 'view'")
    offered = marks.select("source_id", "stream", F.lit(1).cast("long").alias("n_rows"), (F.col("mark") + 2).alias("first_ts"), (F.col("mark") + 2).alias("last_ts"))
    payload = marks.select("source_id", "stream", (F.col("mark") + 2).alias("ts"), F.lit(0).cast("long").alias("wall_offset"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"), F.lit(-1).cast("long").alias("event_id"))
    out = seal.adopted(a, offered, payload)
    return out.segments.groupBy("source_id", "stream").agg(F.max("seq").alias("seq"), F.max("last_ts").alias("last_ts"), F.sum("n_rows").alias("n_rows"))


SYNCED = f""", points AS (SELECT source_id, stream, CASE WHEN source_id = 1 THEN max(last_ts) ELSE min(last_ts) + (source_id - 2) * {2 * SLICE} END AS at_ FROM segments WHERE stream <> 'click' GROUP BY source_id, stream),
cut AS (SELECT p.* FROM points p WHERE NOT EXISTS (SELECT 1 FROM segments s WHERE s.source_id = p.source_id AND s.stream = p.stream AND s.first_ts <= at_ AND at_ < s.last_ts))
"""


@on_archive("w12_synced_catalog", SYNCED + f"""SELECT s.source_id, s.stream, s.seq, s.n_rows FROM segments s LEFT JOIN cut c ON s.source_id = c.source_id AND s.stream = c.stream WHERE at_ IS NULL OR first_ts <= at_
UNION ALL SELECT l.source_id, l.stream, any_value(m.n), count(*) FROM live l JOIN cut c ON l.source_id = c.source_id AND l.stream = c.stream JOIN (SELECT {K}, max(seq) + 1 AS n FROM segments GROUP BY {K}) m ON l.source_id = m.source_id AND l.stream = m.stream WHERE l.ts <= at_ GROUP BY l.source_id, l.stream""")
def w12_catalog(a):
    return synced(a).segments.select("source_id", "stream", "seq", "n_rows")


@on_archive("w12_synced_wal", SYNCED + "SELECT w.source_id, w.stream, w.ts, w.event_id FROM wal w WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.source_id = w.source_id AND c.stream = w.stream)")
def w12_wal(a):
    return synced(a).wal.select("source_id", "stream", "ts", "event_id")


@on_archive("w12_synced_bounds", SYNCED + f""", tops AS (SELECT {K}, max(ts) AS newest FROM (SELECT {K}, ts FROM wal UNION ALL SELECT {K}, last_ts FROM segments) GROUP BY {K})
SELECT source_id, kind, name, max(ts) AS ts FROM (SELECT * FROM bounds UNION ALL SELECT t.source_id, 0, t.stream, newest FROM tops t JOIN cut c ON t.source_id = c.source_id AND t.stream = c.stream WHERE newest > at_) GROUP BY source_id, kind, name""")
def w12_bounds(a):
    return synced(a).bounds


def synced(a):
    points = a.segments.where("stream <> 'click'").groupBy("source_id", "stream").agg(F.min("last_ts").alias("lo"), F.max("last_ts").alias("hi"))
    return seal.synced(a, points.select("source_id", "stream", F.when(F.col("source_id") == 1, F.col("hi")).otherwise(F.col("lo") + (F.col("source_id") - 2) * 2 * SLICE).alias("at")))


@on_archive("w17_heartbeat", "SELECT id, CASE WHEN id = 2 THEN heartbeat + 1 ELSE heartbeat END AS heartbeat, CASE WHEN id = 2 THEN 7 ELSE heartbeat_interval END AS heartbeat_interval FROM sources")
def w17(a):
    return ingest.beat(a.sources, 2, 7).select("id", "heartbeat", "heartbeat_interval")


@on_archive("d6_delete_tail", f"SELECT * FROM wal WHERE NOT (source_id = 1 AND stream = 'view' AND ts > {CUTOFF} AND ts <= {LAST})")
def d6_tail(a):
    return retention.delete_tail(a, 1, "view", CUTOFF, LAST).wal


@on_archive("d4_discard_bounds", f"""SELECT source_id, kind, name, max(ts) AS ts FROM (SELECT * FROM bounds UNION ALL
  SELECT t.source_id, 0, t.stream, t.ts FROM (SELECT {K}, max(ts) AS ts FROM (SELECT {K}, ts FROM wal UNION ALL SELECT {K}, last_ts FROM segments) GROUP BY {K}) t
  WHERE t.source_id IN (1, 2) AND EXISTS (SELECT 1 FROM live l WHERE l.source_id = t.source_id AND l.stream = t.stream)) GROUP BY source_id, kind, name""")
def d4_bounds(a):
    return retention.discard_live(a, F.col("source_id").isin(1, 2)).bounds
