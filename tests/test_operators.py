"""Operators against row-by-row versions, on cases that the driver tables lack."""

from __future__ import annotations

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidemark.model import BOUNDS, CALLER_ROWS, CLOCK_OFFSETS, DOCUMENTS, SEGMENT_INDEXES, SEGMENTS, SOURCES, WAL, Archive
from tidemark.operators import documents, ingest, read, replicate, retention, rewrite, scan, seal, stats, verify


def archive(spark, segments=(), wal=(), **more):
    make = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    payload = [(s, n, q, ts, 0, b"") for s, n, q, _, lo, hi, _ in segments for ts in ({lo, hi})]
    return Archive(
        make(more.get("sources", []), SOURCES), make(segments, SEGMENTS), make(payload, "source_id long, stream string, seq long, ts long, wall_offset long, row binary"), make([(s, n, ts, 0, b"") for s, n, ts in wal], WAL), make(more.get("indexes", []), SEGMENT_INDEXES),
        make(more.get("clock", []), CLOCK_OFFSETS), make(more.get("callers", []), CALLER_ROWS), make([], DOCUMENTS), make(more.get("bounds", []), BOUNDS),
    )


def times(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_live_rows_over_the_whole_range(spark):
    top = (1 << 63) - 1
    a = archive(spark, [(1, "s", 0, 2, -5, 0, 1)], [(1, "s", -1), (1, "s", 0), (1, "s", 1), (1, "s", top), (1, "t", -top), (2, "s", 0)])
    assert times(scan.live(a.wal, a.segments), "source_id", "stream", "ts") == [(1, "s", 1), (1, "s", top), (1, "t", -top), (2, "s", 0)]
    assert times(scan.streams(a.segments, a.wal), "source_id", "stream") == [(1, "s"), (1, "t"), (2, "s")]
    assert [r.sealed for r in read.seam(a, ["ts"]).orderBy("source_id", "stream", "seq", "ts").collect()] == [True, True, False, False, False, False]


def test_empty_archive(spark):
    a = archive(spark)
    for df in (read.catalog(a), scan.live(a.wal, a.segments), stats.newest_rows(a), verify.problems(a), read.seam(a, ["ts"]), rewrite.compact(a, 10).archive.segments, replicate.resume_spans(a)):
        assert df.count() == 0
    assert read.describe(a).first().n_streams == 0
    assert retention.evict(a, 1, 5).report.first().asDict() == {"segments": 0, "wal_rows": 0, "kept_live_rows": 0, "caller_rows": 0}


def plain_admission(rows, newest, floors):
    """Tick by tick, row by row."""
    out, held = {}, dict(newest)
    for t in sorted({r[2] for r in rows}):
        batch = [r for r in rows if r[2] == t]
        below = {s for s, f in floors.items() if any(r[0] == s and r[3] <= f for r in batch)}
        seen, before = set(), dict(held)
        for s, stream, _, ts, o in sorted(batch, key=lambda r: r[4]):
            k = (s, stream)
            if s in below:
                out[o] = "below_floor"
            elif k in before and ts <= before[k]:
                out[o] = "late"
            elif (k, ts) in seen:
                out[o] = "repeated"
            else:
                seen.add((k, ts))
                out[o] = "accepted"
                held[k] = max(held.get(k, ts), ts)
    return out


def test_admission_equals_a_row_by_row_loop(spark):
    rng = random.Random(11)
    everything, expected = [], {}
    for case in range(60):
        rows = [(10 * case + rng.randrange(2), rng.choice("ab"), rng.randrange(6), rng.randrange(12), case * 100 + i) for i in range(30)]
        newest = {(10 * case, "a"): rng.randrange(6)} if case % 2 else {}
        floors = {10 * case + 1: rng.randrange(4)} if case % 3 == 0 else {}
        expected |= plain_admission(rows, newest, floors)
        everything.append((rows, newest, floors))
    df = spark.createDataFrame([r for rows, _, _ in everything for r in rows], "source_id long, stream string, tick long, ts long, ord long")
    newest = spark.createDataFrame([(*k, v) for _, n, _ in everything for k, v in n.items()], "source_id long, stream string, newest long")
    floors = spark.createDataFrame([(k, v) for _, _, f in everything for k, v in f.items()], "source_id long, floor long")
    assert {r.ord: r.outcome for r in ingest.admit(df, newest, floors).collect()} == expected


def test_capped_seal(spark):
    a = archive(spark, wal=[(1, "s", 1000 * k) for k in range(1, 8)])
    parts = seal.sealed_parts(scan.live(a.wal, a.segments), stats.next_seqs(a.segments), 2, 2500)
    assert times(seal.segments_of(parts), "seq", "n_rows", "first_ts", "last_ts") == [(0, 2, 1000, 2000), (1, 2, 3000, 4000), (2, 2, 5000, 6000), (3, 1, 7000, 7000)]
    inner = seal.tiled(parts, parts.where("ts <> 3000"))
    assert times(inner, "seq", "n_rows", "fallback") == [(0, 6, True)]
    outer = seal.tiled(parts, parts.where("ts <> 1000"))
    assert times(outer, "seq", "n_rows", "first_ts", "fallback") == [(0, 1, 2000, False), (1, 2, 3000, False), (2, 2, 5000, False), (3, 1, 7000, False)]


def test_first_segments_are_staggered(spark):
    rows = spark.createDataFrame([(1, s, t, 1) for s in "ab" for t in range(300)], "source_id long, stream string, ts long, n_bytes long")
    policy = seal.SealPolicy(max_rows=128, max_bytes=1 << 30, max_age=1 << 40)
    got = seal.due(rows, policy, F.when(F.col("stream") == "b", 32).otherwise(0)).groupBy("stream", "seq").count()
    assert times(got, "stream", "seq", "count") == [("a", 0, 128), ("a", 1, 128), ("a", 2, 44), ("b", 0, 96), ("b", 1, 128), ("b", 2, 76)]
    assert seal.SealPolicy(max_rows=3, max_bytes=1, max_age=0).staggered(63) == seal.SealPolicy(max_rows=3, max_bytes=1, max_age=0)


def test_eviction_keeps_live_rows_and_records_bounds(spark):
    a = archive(spark, [(1, "s", 0, 2, 1, 2, 1), (1, "s", 1, 2, 3, 9, 1)], [(1, "s", 2), (1, "s", 10), (1, "t", 4)], clock=[(1, 2, 0), (1, 9, 0)], callers=[(1, "s", 1, 0, "x"), (1, "n", 4, 1, "y"), (1, "s", 8, 2, "z")], indexes=[(1, "s", 0, b"i"), (1, "s", 1, b"j")])
    e = retention.evict(a, 1, 5)
    assert e.report.first().asDict() == {"segments": 1, "wal_rows": 1, "kept_live_rows": 1, "caller_rows": 2}
    b = e.archive
    assert times(b.segments, "seq") == [(1,)] and times(b.segment_indexes, "seq") == [(1,)] and times(b.payload, "ts") == [(3,), (9,)]
    assert times(b.wal, "stream", "ts") == [("s", 10), ("t", 4)]
    assert times(b.clock_offsets, "ts") == [(9,)] and times(b.caller_rows, "ts") == [(8,)]
    assert times(b.bounds, "kind", "name", "ts") == [(0, "t", 4), (1, "n", 4)]
    floored = retention.evict(a, 1, 9, floor=F.coalesce("oldest", F.lit(100)))
    assert times(floored.archive.caller_rows, "ts") == [(8,)]  # s: its oldest stream row is 3; n has no stream row
    d = retention.discard_live(a, F.lit(True))
    assert times(d.wal, "ts") == [(2,)] and times(d.bounds, "name", "ts") == [("s", 10), ("t", 4)]
    p = retention.prune(a, 1, "s", 10)
    assert times(p.wal, "stream", "ts") == [("t", 4)] and times(p.bounds, "name", "ts") == [("s", 10)]
    assert times(retention.delete_tail(a, 1, "s", 2, 10).wal, "stream", "ts") == [("s", 2), ("t", 4)]


def plain_runs(segments, target, agree):
    out, at = {}, 0
    while at < len(segments):
        end, rows = at, 0
        while end < len(segments) and rows + segments[end][1] <= max(target, 1):
            rows += segments[end][1]
            end += 1
        while end - at > 1 and not agree([s[2] for s in segments[at:end]]):
            end -= 1
        end = max(end, at + 1)
        out |= {s[0]: segments[at][0] for s in segments[at:end]}
        at = end
    return out


def no_field_differs(shapes):
    seen = {}
    return all(seen.setdefault(k, v) == v for s in shapes for k, v in s.items())


@pytest.mark.parametrize(("policy", "agree"), [(rewrite.STOP_AT_CHANGE, lambda s: all(x == s[0] for x in s)), (rewrite.UNION_FIELDS, no_field_differs)])
def test_runs_equal_a_plain_planner(spark, policy, agree):
    rng = random.Random(3)
    streams = {f"s{k}": [(q, rng.choice([1, 5, 9, 40]), {"a": "long", rng.choice("bc"): rng.choice(["int", "long"])} if rng.random() < 0.4 else {"a": "long"}) for q in range(25)] for k in range(8)}
    rows = [(1, s, q, n, q, q, n, shape) for s, segs in streams.items() for q, n, shape in segs]
    df = spark.createDataFrame(rows, SEGMENTS + ", fields map<string,string>")
    got = {(r.stream, r.seq): r.run for r in rewrite.plan_runs(df, 30, policy).collect()}
    assert got == {(s, q): run for s, segs in streams.items() for q, run in plain_runs(segs, 30, agree).items()}


def test_sync_points(spark):
    rng = random.Random(6)
    spans, wanted, expected = [], [], {}
    for k in range(40):
        mine = [(lo, lo + rng.randrange(6)) for lo in rng.sample(range(30), 5)]
        low, high = rng.randrange(10), rng.randrange(10, 35)
        spans += [(k, "s", *x) for x in mine]
        wanted.append((k, "s", low, high))
        fits = [v for v in range(low, high + 1) if not any(f <= v < e for f, e in mine)]
        expected[k] = max(fits, default=None)
    got = replicate.sync_points(spark.createDataFrame(spans, "source_id long, stream string, first_ts long, last_ts long"), spark.createDataFrame(wanted, "source_id long, stream string, low long, high long"))
    assert {r.source_id: r["at"] for r in got.collect()} == expected


def test_frames_that_resume_streams(spark):
    # newest row of the copy, oldest of the origin, the copy's spans, the origin's segments, the frames wanted
    cases = {
        "in step": (9, 0, [(0, 9)], [(0, 9), (10, 12)], [("SegmentAfter", 9, 10)]),
        "live only": (14, 0, [(0, 9)], [(0, 9), (10, 12), (13, 20)], [("SegmentGroup", None, None), ("SegmentAfter", 9, 10), ("SegmentAfter", 12, 13)]),
        "drawn otherwise": (9, 0, [(5, 9)], [(4, 11)], [("Sync", 3, None), ("SegmentAfter", 3, 4)]),
        "lost": (5, 20, [(0, 5)], [(20, 22)], [("Unavailable", 5, None), ("SegmentAfter", 5, 20)]),
        "no point": (9, 5, [(4, 9), (0, 4)], [(3, 12)], [("NoSyncPoint", 4, None)]),
        "nothing sealed": (7, 0, [], [(0, 3)], [("Sync", -1, None), ("SegmentAfter", -1, 0)]),
    }
    held = [(1, name, c[0]) for name, c in cases.items()]
    spans = [(1, name, *s) for name, c in cases.items() for s in c[2]]
    segments = [(1, name, seq, 1, *s) for name, c in cases.items() for seq, s in enumerate(c[3])]
    oldest = [(1, name, c[1]) for name, c in cases.items()]
    got = replicate.resume_frames(
        spark.createDataFrame(held, "source_id long, stream string, newest long"), spark.createDataFrame(spans, "source_id long, stream string, first_ts long, last_ts long"),
        spark.createDataFrame(segments, "source_id long, stream string, seq long, n_rows long, first_ts long, last_ts long"), spark.createDataFrame(oldest, "source_id long, stream string, oldest long"),
    ).orderBy("stream", "place", "first_ts").collect()
    for name, case in cases.items():
        assert [(r.kind, r["at"], r.first_ts) for r in got if r.stream == name] == case[4], name
    assert [r.n for r in got if r.kind == "SegmentGroup"] == [2]


def test_resume_request_round_trip(spark):
    from tidemark.sources import wire

    a = archive(spark, [(1, "s", q, 1, 10 * q, 10 * q + 5, 1) for q in range(5)], [(1, "s", 99), (1, "t", 3), (2, "s", 1)], sources=[(1, {}, {}, False, 0, "u1", None, None), (2, {}, {}, False, 0, None, None, None)], callers=[(1, "n", 4, 0, "x"), (1, "n", 4, 1, "y")])
    request = replicate.resume_request(a, 0, most=3)
    assert wire.decode_request(wire.encode_request(request)) == request
    (s,) = request["sources"]
    assert [(t["stream"], t["newest"], [x["last_ts"] for x in t["spans"]]) for t in s["streams"]] == [("s", 99, [45, 35, 25]), ("t", 3, [])]
    assert s["names"] == [{"name": "n", "ts": 4, "at_ts": 2}]


def test_document_forks_only_when_a_head_is_displaced(spark):
    put = lambda i, u, name, sup, body="{}": (i, u, "k", name, "t" if body else None, body, 0, sup)
    dst = [put(1, "a", "x", None), put(2, "mine", "x", 1), put(3, "b", "y", None), put(4, "gone", "z", None, None), put(5, "c", "w", None)]
    src = [put(11, "a", "x", None), put(12, "yours", "x", 11), put(13, "b", "y", None), put(14, "later", "y", 13), put(15, "new", "z", None), put(16, "c", "w", None, '{"other": 1}'), put(17, "lone", "v", 99)]
    c = documents.copy(spark.createDataFrame(src, DOCUMENTS), spark.createDataFrame(dst, DOCUMENTS))
    assert times(c.conflicts, "uuid") == [("c",)]
    assert sorted((r.id, r.uuid, r.supersedes) for r in c.inserted.collect()) == [(6, "yours", 1), (7, "later", 3), (8, "new", None), (9, "lone", None)]
    assert {(r.name, r.forked, r.displaced) for r in c.report.collect()} == {("x", True, "mine"), ("y", False, None), ("z", False, None), ("v", False, None)}


def test_index_states_of_every_source_equal_a_plain_fold(spark):
    from tidemark import plans
    from tidemark.functions.hashes import NO_STATE, fold_state
    from tidemark.plans import derive

    sf, expected, states = "/root/testdata/sf0.001", [], {}
    for r in sorted(derive.archive(spark, sf).caller_rows.collect(), key=lambda r: (r.source_id, r.ts, r.ord)):
        state, names = states.get(r.source_id, (NO_STATE, set()))
        state = fold_state(state, [(r.ts, r.blob.encode())])
        expected.append((r.source_id, r.stream, r.ts, r.ord, str(state[0]), str(state[1]), "delta" if r.stream in names else "full"))
        states[r.source_id] = state, names | {r.stream}
    assert len(states) == derive.SOURCES
    assert times(plans.queries()["x4_index_states"](spark, sf), "source_id", "stream", "ts", "ord", "state_a", "state_b", "index_kind") == sorted(expected)


def test_entries_after_a_position_within_a_time(spark):
    """Of entries at a name's newest old time, those beyond the number it held there are new; names that it lacked are new throughout."""
    rows = lambda *names: spark.createDataFrame([(1, n, ts, o, "") for n, ts, o in names], CALLER_ROWS)
    old = [("a", 5, 0), ("a", 9, 1), ("a", 9, 2), ("b", 9, 0)]
    new = replicate.new_index_entries(rows(*old), rows(*old, ("a", 9, 3), ("a", 9, 4), ("a", 10, 5), ("c", 1, 0), ("c", 1, 1)))
    assert times(new, "stream", "ts", "ord") == [("a", 9, 3), ("a", 9, 4), ("a", 10, 5), ("c", 1, 0), ("c", 1, 1)]


def test_every_order_is_a_request(spark):
    from tidemark import plans

    sf = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().count()
    judged = plans.queries()["w19_document_requests"](spark, sf).cache()
    assert orders > 400 and judged.count() == orders
    ids = times(plans.queries()["w19_document_revisions"](spark, sf), "created", "id")
    assert len(ids) == judged.where("outcome IN ('put', 'deleted')").count() and [i for _, i in ids] == list(range(ids[0][1], ids[0][1] + len(ids)))


def test_schema_policy_names(spark):
    with pytest.raises(ValueError, match="schema policy"):
        rewrite.plan_runs(spark.createDataFrame([], SEGMENTS), 1, "whatever")


def test_copies_of_documents_with_many_revisions(spark):
    """1,000 revisions ahead: one that continues what the target has, one that forked, one that both lack in part."""
    ddl = "id long, uuid string, kind string, name string, schema string, body string, created long, supersedes long"

    def line(name, n, start, own=""):
        return [(start + i, f"{name}{own}{i}", "k", name, "s", "{}", i, None if i == 0 else start + i - 1) for i in range(n)]

    straight, forked = line("straight", 1000, 1), line("forked", 1000, 5001)
    src = spark.createDataFrame(straight + forked + line("new", 3, 9001), ddl)
    fork = [(7001, "own", "k", "forked", "s", "{}", 1, 5010)]
    dst = spark.createDataFrame(straight[:10] + forked[:10] + fork, ddl)
    out = documents.copy(src, dst)
    assert out.inserted.count() == 990 + 990 + 3
    assert {(r.name, r.displaced, r.forked) for r in out.report.collect()} == {("straight", None, False), ("forked", "own", True), ("new", None, False)}


def test_requests_of_one_document_follow_each_other(spark):
    docs = spark.createDataFrame([(1, "u1", "k", "a", "s", "{}", 1, None)], "id long, uuid string, kind string, name string, schema string, body string, created long, supersedes long")
    asked = [  # ord, action, name, expected, uuid, the outcome wanted, what it supersedes
        (10, "put_if", "a", "u1", "n10", "put", 1), (11, "put_if", "a", "u1", "n11", "conflict", None), (12, "put_if", "a", "n10", "n12", "put", 2), (13, "delete", "a", None, "n13", "deleted", 3),
        (14, "delete", "a", None, "n14", "absent", None), (15, "put_if", "a", None, "n15", "put", 4), (16, "put_if", "b", "u1", "n16", "conflict", None), (17, "put_if", "b", None, "n17", "put", None), (18, "put", "b", None, "n18", "put", 6),
    ]
    requests = spark.createDataFrame([(o, a, "k", n, "s", "{}", e, u) for o, a, n, e, u, *_ in asked], "ord long, action string, kind string, name string, schema string, body string, expected string, uuid string")
    judged = documents.judge(docs, requests)
    assert {r.ord: r.outcome for r in judged.collect()} == {a[0]: a[5] for a in asked}
    added = {r.uuid: r.supersedes for r in documents.applied(docs, judged.withColumn("created", F.col("ord"))).collect()}
    assert added == {a[4]: a[6] for a in asked if a[5] in ("put", "deleted")}


def test_requests_of_one_document_stay_together_when_a_join_becomes_a_broadcast(spark):
    """Requests from eight tasks, each of which expects the one before it; the join is planned by sorting and then run by broadcast."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    docs = spark.createDataFrame([(i + 1, f"u{i}", f"k{i}", f"n{i}", "s", "{}", 1, None) for i in range(8)], DOCUMENTS)
    asked = spark.range(8, 808, 1, 8).selectExpr("id AS ord", "'put_if' AS action", "concat('k', id % 8) AS kind", "concat('n', id % 8) AS name", "'s' AS schema", "'{}' AS body", "concat('u', id - 8) AS expected", "concat('u', id) AS uuid")
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert {r.outcome: r["count"] for r in documents.judge(docs, asked).groupBy("outcome").count().collect()} == {"put": 800}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_combine_refuses_what_both_hold(spark):
    source = lambda i, uuid: (i, {}, {}, False, 0, uuid, None, None)
    ddl = "id long, uuid string, kind string, name string, schema string, body string, created long, supersedes long"
    docs = lambda *rows: spark.createDataFrame([(i, u, "k", n, "s", body, 0, None) for i, u, n, body in rows], ddl)
    make = lambda *sources: archive(spark, sources=sources)
    a, b = make(source(1, "x"), source(2, None)), make(source(1, "y"), source(2, None))
    out = rewrite.combine(replace(a, documents=docs((1, "u", "n", "{}"))), replace(b, documents=docs((5, "v", "m", "{}"), (6, "u", "n", "{}"))))
    assert sorted((r.id, r.uuid) for r in out.sources.collect()) == [(1, "x"), (2, None), (3, "y"), (4, None)]
    assert sorted((r.id, r.uuid) for r in out.documents.collect()) == [(1, "u"), (2, "v")]
    with pytest.raises(rewrite.DuplicateSource, match="x"):
        rewrite.combine(a, make(source(7, "x")))
    with pytest.raises(documents.DocumentConflict, match="u"):
        rewrite.combine(replace(a, documents=docs((1, "u", "n", "{}"))), replace(b, documents=docs((5, "u", "n", "[]"))))
