"""Documents, rewriting and checks as queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import documents, rewrite, verify
from .derive import SLICE
from .derive import documents as revisions
from .registry import on_archive, query

K = "source_id, stream"
START, END = 1_704_672_000_000_000, 1_705_276_800_000_000


@on_archive("s17_documents", "SELECT * FROM docs d WHERE kind = 'user' AND id = (SELECT max(id) FROM docs m WHERE m.kind = d.kind AND m.name = d.name) AND body IS NOT NULL")
def s17(a):
    return documents.current(a.documents, "user")


@on_archive("s17_document_kinds", "SELECT DISTINCT kind FROM docs d WHERE id = (SELECT max(id) FROM docs m WHERE m.kind = d.kind AND m.name = d.name) AND body IS NOT NULL")
def s17_kinds(a):
    return documents.kinds(a.documents)


@on_archive("s17_document_history", "SELECT * FROM docs WHERE kind = 'assistant' AND name = '3'")
def s17_history(a):
    return documents.history(a.documents, "assistant", "3")


W19 = """, heads AS (SELECT d.* FROM docs d WHERE id = (SELECT max(id) FROM docs m WHERE m.kind = d.kind AND m.name = d.name)),
requests AS (
  SELECT l_linenumber * 10000000 + l_orderkey AS ord, CASE l_linenumber % 3 WHEN 0 THEN 'delete' WHEN 1 THEN 'put_if' ELSE 'put' END AS action,
         CASE WHEN l_orderkey % 11 = 0 THEN 'tidemark.x' WHEN l_orderkey % 2 = 0 THEN 'user' ELSE 'assistant' END AS kind, CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE l_orderkey::VARCHAR END AS name,
         CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'turn/2' END AS schema, CASE WHEN l_orderkey % 5 = 0 THEN 'no json' ELSE '[1, 2]' END AS body
  FROM (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey)),
judged AS (
  SELECT r.ord, r.action, r.kind, r.name, r.schema, r.body, h.id AS head_id, CASE WHEN h.body IS NOT NULL THEN h.uuid END AS head_uuid, CASE WHEN r.ord % 2 = 0 THEN CASE WHEN h.body IS NOT NULL THEN h.uuid END ELSE 'other' END AS expected
  FROM requests r LEFT JOIN heads h ON r.kind = h.kind AND r.name = h.name),
outcomes AS (
  SELECT *, CASE WHEN kind = '' OR name = '' THEN 'needs_key' WHEN starts_with(kind, 'tidemark.') THEN 'reserved' WHEN action <> 'delete' AND coalesce(schema, '') = '' THEN 'needs_schema'
       WHEN action <> 'delete' AND NOT json_valid(body) THEN 'not_json' WHEN action = 'put_if' AND head_uuid IS DISTINCT FROM expected THEN 'conflict'
       WHEN action = 'delete' AND head_uuid IS NULL THEN 'absent' WHEN action = 'delete' THEN 'deleted' ELSE 'put' END AS outcome FROM judged)
"""

def requests(spark, sf_dir, docs):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("n"))
    k, n = F.col("l_orderkey"), F.col("n")
    r = lines.select(
        (n * 10_000_000 + k).alias("ord"), F.when(n % 3 == 0, "delete").when(n % 3 == 1, "put_if").otherwise("put").alias("action"),
        F.when(k % 11 == 0, "tidemark.x").when(k % 2 == 0, "user").otherwise("assistant").alias("kind"), F.when(k % 13 == 0, "").otherwise(k.cast("string")).alias("name"),
        F.when(k % 7 == 0, "").otherwise("turn/2").alias("schema"), F.when(k % 5 == 0, "no json").otherwise("[1, 2]").alias("body"),
    )
    h = documents.current(docs).select("kind", "name", F.col("uuid").alias("_u"))
    return r.join(h, ["kind", "name"], "left").withColumn("expected", F.when(F.col("ord") % 2 == 0, F.col("_u")).otherwise("other")).drop("_u")


@query("w19_document_requests", W19 + "SELECT ord, kind, name, outcome FROM outcomes")
def w19(spark, sf_dir):
    docs = revisions(spark, sf_dir)
    return documents.judge(docs, requests(spark, sf_dir, docs)).select("ord", "kind", "name", "outcome")


REVISED = """SELECT (SELECT max(id) FROM docs) + row_number() OVER (ORDER BY ord) AS id, md5(ord::VARCHAR) AS uuid, kind, name, CASE WHEN outcome = 'put' THEN schema END AS schema, CASE WHEN outcome = 'put' THEN body END AS body, ord AS created, head_id AS supersedes
FROM outcomes WHERE outcome IN ('put', 'deleted')"""


@query("w19_document_revisions", W19 + REVISED)
def w19_revisions(spark, sf_dir):
    docs = revisions(spark, sf_dir)
    own = {"uuid": F.md5(F.col("ord").cast("string")), "created": F.col("ord")}
    return documents.applied(docs, documents.judge(docs, requests(spark, sf_dir, docs).withColumns(own)))


#: Every order line is a request, so a document gets several: each meets the head that those before it left.
W19_LINES = W19.replace("FROM (SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey)", "FROM lineitem").replace("CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE l_orderkey::VARCHAR END", "(l_orderkey % 3000)::VARCHAR").replace("ELSE 'other' END AS expected", "WHEN r.ord % 3 = 0 THEN md5((r.ord - 10000000)::VARCHAR) END AS expected") + """, valid AS (
  SELECT *, row_number() OVER (PARTITION BY kind, name ORDER BY ord) AS rn FROM outcomes WHERE outcome IN ('put', 'conflict', 'deleted', 'absent')),
folded AS (
  SELECT kind, name, 0::BIGINT AS rn, NULL::BIGINT AS ord, NULL::VARCHAR AS outcome, any_value(head_uuid) AS at_uuid FROM valid GROUP BY kind, name
  UNION ALL
  SELECT v.kind, v.name, v.rn, v.ord, o, CASE o WHEN 'put' THEN md5(v.ord::VARCHAR) WHEN 'deleted' THEN NULL ELSE f.at_uuid END
  FROM folded f JOIN valid v ON v.kind = f.kind AND v.name = f.name AND v.rn = f.rn + 1,
  LATERAL (SELECT CASE WHEN v.action = 'put_if' AND f.at_uuid IS DISTINCT FROM v.expected THEN 'conflict' WHEN v.action = 'delete' AND f.at_uuid IS NULL THEN 'absent' WHEN v.action = 'delete' THEN 'deleted' ELSE 'put' END AS o) x)
SELECT ord, kind, name, outcome FROM folded WHERE rn > 0
UNION ALL SELECT ord, kind, name, outcome FROM outcomes WHERE outcome NOT IN ('put', 'conflict', 'deleted', 'absent')"""


@query("w19_request_sequences", W19_LINES)
def w19_lines(spark, sf_dir):
    docs = revisions(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").alias("n"))
    k, n = F.col("l_orderkey"), F.col("n")
    r = lines.select(
        (n * 10_000_000 + k).alias("ord"), F.when(n % 3 == 0, "delete").when(n % 3 == 1, "put_if").otherwise("put").alias("action"),
        F.when(k % 11 == 0, "tidemark.x").when(k % 2 == 0, "user").otherwise("assistant").alias("kind"), (k % 3000).cast("string").alias("name"),
        F.when(k % 7 == 0, "").otherwise("turn/2").alias("schema"), F.when(k % 5 == 0, "no json").otherwise("[1, 2]").alias("body"),
    )
    h = documents.current(docs).select("kind", "name", F.col("uuid").alias("_u"))
    earlier = F.when(F.col("ord") % 3 == 0, F.md5((F.col("ord") - 10_000_000).cast("string")))
    r = r.join(h, ["kind", "name"], "left").withColumn("expected", F.when(F.col("ord") % 2 == 0, F.col("_u")).otherwise(earlier)).drop("_u")
    return documents.judge(docs, r.withColumn("uuid", F.md5(F.col("ord").cast("string")))).select("ord", "kind", "name", "outcome")


C8 = """, own AS (SELECT 1000000000000000 + conv_id AS id, md5('own' || conv_id) AS uuid, 'user' AS kind, conv_id::VARCHAR AS name, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE 'turn/1' END AS schema, CASE WHEN conv_id % 9 = 0 THEN NULL ELSE '{}' END AS body, conv_id AS created FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0)),
dst AS (
  SELECT * FROM docs WHERE id < 2 * 4294967296
  UNION ALL SELECT o.*, (SELECT max(id) FROM docs d WHERE d.kind = o.kind AND d.name = o.name AND d.id < 2 * 4294967296) AS supersedes FROM own o),
src AS (SELECT * FROM docs),
new AS (SELECT s.*, (SELECT max(id) FROM dst) + row_number() OVER (ORDER BY s.id) AS new_id FROM src s WHERE uuid NOT IN (SELECT uuid FROM dst)),
ids AS (SELECT id, new_id FROM new UNION ALL SELECT s.id, d.id FROM src s JOIN dst d ON s.uuid = d.uuid),
inserted AS (SELECT n.new_id AS id, n.uuid, n.kind, n.name, n.schema, n.body, n.created, i.new_id AS supersedes FROM new n LEFT JOIN ids i ON n.supersedes = i.id),
tops AS (SELECT kind, name, max(id) AS top, arg_max(uuid, id) AS current FROM inserted GROUP BY kind, name),
before AS (SELECT kind, name, max(id) AS target, arg_max(uuid, id) AS displaced, arg_max(schema IS NULL, id) AS deleted FROM dst GROUP BY kind, name),
after AS (SELECT id, supersedes FROM dst UNION ALL SELECT id, supersedes FROM inserted),
line AS (
  SELECT t.kind, t.name, b.target, t.top AS node FROM tops t JOIN before b ON t.kind = b.kind AND t.name = b.name
  UNION ALL SELECT l.kind, l.name, l.target, a.supersedes FROM line l JOIN after a ON a.id = l.node WHERE a.supersedes IS NOT NULL AND l.node <> l.target),
reach AS (SELECT kind, name, bool_or(node = target) AS reaches, bool_or(node <= (SELECT max(id) FROM dst)) AS shares FROM line GROUP BY kind, name),
report AS (
  SELECT t.kind, t.name, b.displaced, t.current, b.target IS NOT NULL AND NOT r.reaches AND (NOT b.deleted OR r.shares) AS forked
  FROM tops t LEFT JOIN before b ON t.kind = b.kind AND t.name = b.name LEFT JOIN reach r ON t.kind = r.kind AND t.name = r.name)
"""


def copied(spark, sf_dir):
    docs = revisions(spark, sf_dir)
    old = docs.where("id < 2 * 4294967296")
    edits = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("conv_id % 3 = 0").select("conv_id").distinct()
    c, put = F.col("conv_id"), F.col("conv_id") % 9 != 0
    last = old.where("kind = 'user'").groupBy("name").agg(F.max("id").alias("supersedes"))
    own = edits.select((c + 1_000_000_000_000_000).alias("id"), F.md5(F.concat(F.lit("own"), c)).alias("uuid"), F.lit("user").alias("kind"), c.cast("string").alias("name"), F.when(put, "turn/1").alias("schema"), F.when(put, "{}").alias("body"), c.alias("created")).join(last, "name", "left")
    return documents.copy(docs, old.unionByName(own))


@query("c8_document_copy", C8 + "SELECT * FROM inserted")
def c8(spark, sf_dir):
    return copied(spark, sf_dir).inserted


@query("c8_document_forks", C8 + "SELECT kind, name, CASE WHEN forked THEN displaced END AS displaced, current, forked FROM report")
def c8_forks(spark, sf_dir):
    return copied(spark, sf_dir).report


TARGET = 70


def runs_sql(step: str) -> str:
    return f""", numbered AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY seq) AS rn, {step} AS shape FROM segments),
runs AS (
  SELECT {K}, seq, n_rows, first_ts, last_ts, n_bytes, rn, shape, seq AS run, n_rows AS held, shape AS first_shape FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source_id, n.stream, n.seq, n.n_rows, n.first_ts, n.last_ts, n.n_bytes, n.rn, n.shape, CASE WHEN go THEN r.run ELSE n.seq END, CASE WHEN go THEN r.held + n.n_rows ELSE n.n_rows END, CASE WHEN go THEN r.first_shape ELSE n.shape END
  FROM runs r JOIN numbered n ON n.source_id = r.source_id AND n.stream = r.stream AND n.rn = r.rn + 1, LATERAL (SELECT r.held + n.n_rows <= {TARGET} AND n.shape = r.first_shape AS go) g)
"""


@on_archive("c1_plan_runs", runs_sql("0") + f"SELECT {K}, seq, run FROM runs")
def c1(a):
    return rewrite.plan_runs(a.segments, TARGET).select("source_id", "stream", "seq", "run")


def shaped(a):
    """Segments whose fields change every fifth segment."""
    return a.segments.withColumn("fields", F.create_map(F.lit("value"), F.when(F.col("seq") % 10 < 5, "double").otherwise("long")))


@on_archive("c2_stop_at_change", runs_sql("seq % 10 < 5") + f"SELECT {K}, seq, run FROM runs")
def c2(a):
    return rewrite.plan_runs(shaped(a), TARGET).select("source_id", "stream", "seq", "run")


@on_archive("c2_union_fields", runs_sql("0") + f"SELECT {K}, seq, run FROM runs")
def c2_union(a):
    fields = F.create_map(F.lit("value"), F.lit("double"), F.concat(F.lit("extra"), F.col("seq")), F.lit("long"))
    return rewrite.plan_runs(a.segments.withColumn("fields", fields), TARGET, rewrite.UNION_FIELDS).select("source_id", "stream", "seq", "run")


@on_archive("c3_metadata_merge", runs_sql("seq // 3") + f"SELECT {K}, seq, run FROM runs")
def c3(a):
    kv = F.create_map(F.lit("layout"), F.expr("seq div 3").cast("string"))
    return rewrite.plan_runs(a.segments.withColumn("metadata", kv), TARGET).select("source_id", "stream", "seq", "run")


@on_archive("c4_compacted_catalog", runs_sql("0") + f"SELECT {K}, run AS seq, sum(n_rows)::BIGINT AS n_rows, min(first_ts) AS first_ts, max(last_ts) AS last_ts, sum(n_bytes)::BIGINT AS n_bytes FROM runs GROUP BY {K}, run")
def c4(a):
    return rewrite.compact(a, TARGET).archive.segments


@on_archive("c4_compacted_payload", runs_sql("0") + f"SELECT p.source_id, p.stream, r.run AS seq, p.ts, p.event_id FROM payload p JOIN runs r ON p.source_id = r.source_id AND p.stream = r.stream AND p.seq = r.seq")
def c4_payload(a):
    return rewrite.compact(a, TARGET).archive.payload.select("source_id", "stream", "seq", "ts", "event_id")


@on_archive("c4_compaction_report", runs_sql("0") + f", sized AS (SELECT {K}, run, count(*) AS n FROM runs GROUP BY {K}, run) SELECT {K}, sum(n)::BIGINT AS before, count(*) AS after, count(*) FILTER (n > 1) AS merges FROM sized GROUP BY {K}")
def c4_report(a):
    return rewrite.compact(a, TARGET).report


C5 = f""", taken AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY seq) - 1 AS new_seq FROM segments WHERE source_id IN (1, 3) AND stream <> 'error' AND first_ts <= END AND last_ts >= START),
tail AS (SELECT l.* FROM live l JOIN (SELECT {K}, min(ts) AS f, max(ts) AS t FROM live GROUP BY {K}) s USING ({K}) WHERE l.source_id IN (1, 3) AND l.stream <> 'error' AND f <= END AND t >= START),
kept AS (SELECT * FROM tail WHERE event_id % 3 = 0),
ends AS (SELECT {K}, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM kept GROUP BY {K}),
placed_tail AS (SELECT e.*, coalesce(t.n, 0) AS seq FROM ends e LEFT JOIN (SELECT {K}, max(new_seq) + 1 AS n FROM taken GROUP BY {K}) t ON e.source_id = t.source_id AND e.stream = t.stream)
""".replace("START", str(START)).replace("END", str(END + 15 * SLICE))


def copy_spec(**more):
    return rewrite.CopySpec(sources=F.col("labels")["arm"] == "a", streams=F.col("stream") != "error", start=START, end=END + 15 * SLICE, **more)


@on_archive("c5_copy_catalog", C5 + f"SELECT {K}, new_seq AS seq, n_rows, first_ts, last_ts FROM taken UNION ALL SELECT {K}, seq, n_rows, first_ts, last_ts FROM placed_tail")
def c5(a):
    return rewrite.copy(a, copy_spec(encodes=F.col("event_id") % 3 == 0)).segments.drop("n_bytes")


@on_archive("c5_copy_payload", C5 + f"SELECT p.source_id, p.stream, t.new_seq AS seq, p.ts, p.event_id FROM payload p JOIN taken t ON p.source_id = t.source_id AND p.stream = t.stream AND p.seq = t.seq UNION ALL SELECT k.source_id, k.stream, e.seq, k.ts, k.event_id FROM kept k JOIN placed_tail e ON k.source_id = e.source_id AND k.stream = e.stream")
def c5_payload(a):
    return rewrite.copy(a, copy_spec(encodes=F.col("event_id") % 3 == 0)).payload.select("source_id", "stream", "seq", "ts", "event_id")


@on_archive("c5_copy_tail", C5 + "SELECT t.source_id, t.stream, t.ts, t.event_id FROM tail t LEFT JOIN ends e ON t.source_id = e.source_id AND t.stream = e.stream WHERE e.last_ts IS NULL OR t.ts > e.last_ts")
def c5_tail(a):
    return rewrite.copy(a, copy_spec(encodes=F.col("event_id") % 3 == 0)).wal.select("source_id", "stream", "ts", "event_id")


@on_archive("c5_copy_bounds", f""", tops AS (SELECT {K}, max(ts) AS ts FROM (SELECT {K}, ts FROM wal UNION ALL SELECT {K}, last_ts FROM segments UNION ALL SELECT source_id, name, ts FROM bounds WHERE kind = 0) GROUP BY {K}),
floors AS (SELECT coalesce(h.source_id, b.source_id) AS source_id, coalesce(h.stream, b.name) AS stream, greatest(held, bound) AS floor FROM (SELECT {K}, max(ts) AS held FROM caller_rows GROUP BY {K}) h FULL JOIN (SELECT source_id, name, ts AS bound FROM bounds WHERE kind = 1) b ON h.source_id = b.source_id AND h.stream = b.name),
got AS (SELECT {K}, max(ts) AS got FROM caller_rows WHERE ts BETWEEN {START} AND {END + 15 * SLICE} GROUP BY {K})
SELECT source_id, 0 AS kind, stream AS name, ts FROM tops WHERE source_id IN (1, 3) AND stream <> 'error'
UNION ALL SELECT f.source_id, 1, f.stream, f.floor FROM floors f LEFT JOIN got g ON f.source_id = g.source_id AND f.stream = g.stream WHERE f.source_id IN (1, 3) AND f.stream <> 'error' AND (got IS NULL OR got < floor)""")
def c5_bounds(a):
    return rewrite.copy(a, copy_spec()).bounds


@on_archive("c6_projection", f"SELECT p.source_id, p.stream, p.seq, p.ts, p.value FROM payload p UNION ALL SELECT l.source_id, l.stream, coalesce((SELECT max(seq) + 1 FROM segments s WHERE s.source_id = l.source_id AND s.stream = l.stream), 0), l.ts, l.value FROM live l")
def c6(a):
    return rewrite.copy(a, rewrite.CopySpec(columns=["value"], data_columns=["value", "props"])).payload


@on_archive("c7_shared_sources", "SELECT uuid, id FROM sources WHERE uuid IS NOT NULL AND id >= 2")
def c7(a):
    return rewrite.shared_sources(replace(a, sources=a.sources.where("id >= 2")), a)


@on_archive("c9_combine", f"SELECT source_id, stream, count(*) AS n_segments, sum(n_rows)::BIGINT AS n_rows FROM (SELECT source_id, stream, n_rows FROM segments WHERE source_id <= 2 UNION ALL SELECT source_id - 2 + 2, stream, n_rows FROM segments WHERE source_id > 2) GROUP BY {K}")
def c9(a):
    lo = rewrite.copy(a, rewrite.CopySpec(sources=F.col("id") <= 2))
    hi = rewrite.copy(a, rewrite.CopySpec(sources=F.col("id") > 2))
    sealed = lambda x: replace(x, segments=x.segments.where("n_bytes IS NOT NULL"))  # noqa: E731  without the encoded tails
    out = rewrite.combine(sealed(lo), sealed(hi))
    return out.segments.groupBy("source_id", "stream").agg(F.count("*").alias("n_segments"), F.sum("n_rows").alias("n_rows"))


def broken(a):
    """An archive with one of each defect."""
    s = a.segments
    segments = s.where("NOT (source_id = 1 AND seq = 0)").withColumn("first_ts", F.when((F.col("source_id") == 2) & (F.col("seq") == 1), F.col("last_ts") + 1).otherwise(F.col("first_ts"))).withColumn("n_rows", F.when((F.col("source_id") == 2) & (F.col("seq") == 2), 0).otherwise(F.col("n_rows")))
    sources = a.sources.where("id <> 3").withColumn("uuid", F.when(F.col("id") <= 2, "same").otherwise(F.col("uuid")))
    return replace(a, segments=segments, sources=sources)


V1 = f""", bad AS (SELECT source_id, stream, seq, CASE WHEN source_id = 2 AND seq = 2 THEN 0 ELSE n_rows END AS n_rows, CASE WHEN source_id = 2 AND seq = 1 THEN last_ts + 1 ELSE first_ts END AS first_ts, last_ts FROM segments WHERE NOT (source_id = 1 AND seq = 0)),
bad_marks AS (SELECT {K}, max(last_ts) AS mark FROM bad GROUP BY {K})
SELECT 'orphan_segment' AS problem, source_id, stream, seq, 'no such source' AS detail FROM bad WHERE source_id = 3
UNION ALL SELECT DISTINCT 'orphan_wal', source_id, stream, NULL::BIGINT, 'no such source' FROM wal WHERE source_id = 3
UNION ALL SELECT 'orphan_index', source_id, stream, seq, 'no such segment' FROM segment_indexes WHERE source_id = 1 AND seq = 0
UNION ALL SELECT 'inverted_segment', source_id, stream, seq, first_ts || '..' || last_ts FROM bad WHERE first_ts > last_ts
UNION ALL SELECT 'empty_segment', source_id, stream, seq, 'no rows' FROM bad WHERE n_rows = 0
UNION ALL SELECT 'shadowed_wal', w.source_id, w.stream, NULL, count(*)::VARCHAR FROM wal w JOIN bad_marks m ON w.source_id = m.source_id AND w.stream = m.stream AND w.ts <= m.mark GROUP BY w.source_id, w.stream
UNION ALL SELECT 'duplicate_uuid', NULL, NULL, NULL, 'same x2'"""


@on_archive("v1_verify", V1)
def v1(a):
    return verify.problems(broken(a))


@on_archive("v1_counts", f"SELECT (SELECT count(*) FROM sources) AS n_sources, (SELECT count(*) FROM (SELECT {K} FROM segments UNION SELECT {K} FROM wal)) AS n_streams, (SELECT count(*) FROM segments) AS n_segments, (SELECT count(*) FROM wal) AS n_wal")
def v1_counts(a):
    return verify.counts(a)
