from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.model import WAL
from tidemark.operators import read, scan, stats
from tidemark.plans import derive
from tidemark.sources import store as st
from tidemark.streaming import ingest

TICK = "source_id long, stream string, tick long, ts long, ord long, wall_offset long, row binary"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/archive"


def rows(spark, *values):
    return spark.createDataFrame([(1, "s", ts, 0, b"x") for ts in values], WAL)


def test_versions_and_snapshots(spark, root):
    assert st.sniff(spark, root) == "absent"
    s = st.Store.create(spark, root)
    assert st.sniff(spark, root) == "archive" and s.versions() == [0]
    assert s.snapshot().wal.count() == 0
    s.commit({"wal": rows(spark, 1, 2)})
    old = s.snapshot()
    s.commit({"wal": st.Append(rows(spark, 3))})
    s.commit({"wal": rows(spark, 9)})
    assert [old.wal.count(), s.snapshot(2).wal.count(), s.snapshot().wal.count()] == [2, 3, 1]
    assert s.referenced_bytes() > 0
    with pytest.raises(st.Conflict):
        s.commit({"wal": rows(spark, 4)}, expected=1)
    with pytest.raises(st.AlreadyExists):
        st.Store.create(spark, root)
    with pytest.raises(ValueError, match="no relation"):
        s.commit({"walrus": rows(spark, 1)})


def test_a_second_writer_of_a_version_loses(spark, root):
    s = st.Store.create(spark, root)
    s.commit({"wal": rows(spark, 1)})
    with pytest.raises(st.Conflict):
        s.files.create("manifests/00000001.json", "{}")
    assert s.snapshot().wal.count() == 1 and s.versions() == [0, 1]


def test_a_commit_that_fails_leaves_nothing_visible(spark, root):
    s = st.Store.create(spark, root)
    bad = rows(spark, 1).withColumn("ts", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        s.commit({"wal": bad})
    assert s.versions() == [0]


def test_vacuum_and_copy(spark, root, tmp_path):
    s = st.Store.create(spark, root)
    s.commit({"wal": rows(spark, 1)})
    s.commit({"wal": rows(spark, 2)})
    twin = s.copy_to(f"file://{tmp_path}/twin", 1)
    assert [r.ts for r in twin.snapshot().wal.collect()] == [1]
    assert len(s.vacuum()) == 1 and s.versions() == [2]
    assert [r.ts for r in s.snapshot().wal.collect()] == [2]


def test_sniffing(spark, root, tmp_path):
    other = tmp_path / "other"
    (other / "manifests").mkdir(parents=True)
    (other / "manifests" / "00000000.json").write_text("not json")
    assert st.sniff(spark, f"file://{other}") == "other"
    (other / "manifests" / "00000000.json").write_text(json.dumps({"format": st.FORMAT, "schema": 99}))
    assert st.sniff(spark, f"file://{other}") == "unsupported"
    with pytest.raises(st.UnsupportedSchema):
        st.Store(spark, f"file://{other}")
    with pytest.raises(st.NotAnArchive):
        st.Store(spark, root)


def test_an_archive_survives_the_store(spark, root):
    a = derive.archive(spark, "/root/testdata/sf0.001")
    s = st.Store.create(spark, root)
    s.replace(a)
    b = s.snapshot()
    key = lambda x: sorted(map(repr, x.collect()))
    assert key(read.catalog(b).select("source_id", "stream", "sealed_rows", "live_rows")) == key(read.catalog(a).select("source_id", "stream", "sealed_rows", "live_rows"))
    one = scan.of(b.payload, 1, "view")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source_id" in plan and one.count() == scan.of(a.payload, 1, "view").count()


def tick(n, *values):
    return [(1, stream, n, ts, i, 0, b"r") for i, (stream, ts) in enumerate(values)]


def test_streamed_ticks_equal_a_batch(spark, root, tmp_path):
    batches = [tick(0, ("a", 5), ("b", 3), ("a", 5)), tick(1, ("a", 4), ("a", 6), ("b", 9)), tick(2, ("b", 9), ("c", -1), ("a", 7))]
    src = tmp_path / "ticks"
    s = st.Store.create(spark, root)
    for n, b in enumerate(batches):
        spark.createDataFrame(b, TICK).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(TICK).parquet(str(src))
        q = ingest.start(stream, s, f"file://{tmp_path}/checkpoint", availableNow=True)
        q.awaitTermination()
    got = sorted((r.stream, r.ts) for r in s.snapshot().wal.collect())
    assert got == [("a", 5), ("a", 6), ("a", 7), ("b", 3), ("b", 9), ("c", -1)]
    assert ingest.append_batch(s, spark.createDataFrame(batches[2], TICK), 2) is False  # the batch is in
    version = ingest.seal_store(s, 2, 1000)
    sealed = s.snapshot(version)
    assert sorted((r.stream, r.seq, r.n_rows) for r in sealed.segments.collect()) == [("a", 0, 2), ("a", 1, 1), ("b", 0, 2), ("c", 0, 1)]
    assert scan.live(sealed.wal, sealed.segments).count() == 0 and sealed.clock_offsets.count() == 1
    ingest.append_batch(s, spark.createDataFrame(tick(3, ("a", 7), ("a", 8)), TICK), 3)
    assert [(r.stream, r.ts) for r in scan.live(s.snapshot().wal, s.snapshot().segments).collect()] == [("a", 8)]


def test_streamed_liveness_equals_the_window(spark, tmp_path):
    rows = [(s, at, (at // 7 if s != 2 else at // 40) if s != 3 else None, s == 1 and at > 50, 5 if s != 4 else 0) for s in (1, 2, 3, 4, 5) for at in range(0, 80, 3)]
    schema = "source_id long, seen_at long, heartbeat long, complete boolean, heartbeat_interval long"
    expected = sorted(map(tuple, stats.liveness(spark.createDataFrame(rows, schema)).collect()))
    src = tmp_path / "beats"
    for lo in (0, 30, 60):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 30], schema).coalesce(1).write.mode("append").parquet(str(src))
        q = ingest.liveness(spark.readStream.schema(schema).parquet(str(src))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("source_id", "seen_at", "state").collect())) == expected


def test_a_range_is_pushed_to_the_payload(spark, root):
    s = st.Store.create(spark, root)
    a = derive.archive(spark, "/root/testdata/sf0.001")
    s.replace(a)
    held = s.snapshot()
    times = held.segments.agg(F.min("first_ts").alias("lo"), F.max("last_ts").alias("hi")).first()
    middle = (times.lo + times.hi) // 2
    found = scan.payload_within(held.payload, scan.overlapping(held.segments, middle, middle + 3_600_000_000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan and "LessThanOrEqual(ts," in plan
    expected = scan.payload_of(a.payload, scan.overlapping(a.segments, middle, middle + 3_600_000_000))
    assert found.select("event_id").exceptAll(expected.select("event_id")).count() == 0 and found.count() == expected.count() > 0
    assert scan.payload_within(held.payload, held.segments.where("false")).count() == 0
    streams = held.payload.select("source_id", "stream").distinct().count()
    files = [f for f in held.payload.inputFiles()]
    assert len(files) <= 2 * streams
