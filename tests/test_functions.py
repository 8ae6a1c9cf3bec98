from __future__ import annotations

import random
from collections import Counter

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import hashes, times

U64 = 1 << 64


def plain_bucket(stream: str, key: str) -> int:
    """The hash in full 64-bit arithmetic."""
    h = 0xCBF29CE484222325
    for byte in stream.encode() + b"\xff" + key.encode():
        for part in (byte, byte >> 6):
            h = (h ^ part) * 0x100000001B3 % U64
    return h % 64


@given(st.text(max_size=20), st.text(max_size=20))
def test_stagger_bucket(stream, key):
    assert hashes.stagger_bucket(stream, key) == plain_bucket(stream, key)


def test_stagger_spreads_a_stream_set():
    names = [f"stream{i}" for i in range(26)]
    pairs = sum(n * (n - 1) // 2 for k in range(40) for n in Counter(hashes.stagger_bucket(s, f"host=h{k}") for s in names).values())
    assert pairs / 40 < 26 * 25 / 2 / 64  # fewer collisions than chance


def test_identical_staggering():
    assert hashes.staggers_identically("arm=ab", "arm=AB") and not hashes.staggers_identically("arm=a", "arm=A")
    assert not hashes.staggers_identically("a", "ab") and not hashes.staggers_identically("ab", "ac")
    same = all(hashes.stagger_bucket(f"s{i}", "arm=valkey") == hashes.stagger_bucket(f"s{i}", "arm=VALKEY") for i in range(50))
    assert same and hashes.staggers_identically("arm=valkey", "arm=VALKEY")


def test_index_state():
    one = hashes.fold_state(hashes.NO_STATE, [(1, b"a")])
    two = hashes.fold_state(one, [(2, b"b")])
    assert two == hashes.fold_state(hashes.NO_STATE, [(1, b"a"), (2, b"b")])
    assert len({one, two, hashes.fold_state(hashes.NO_STATE, [(2, b"b"), (1, b"a")])}) == 3
    assert hashes.fold_state(hashes.NO_STATE, [(-1, b"")]) != hashes.NO_STATE


def test_buckets_round_down(spark):
    values = [-(1 << 63), -8, -7, -1, 0, 1, 6, 7, (1 << 63) - 1]
    got = spark.createDataFrame([(v,) for v in values], "ts long").select("ts", times.bucket(F.col("ts"), 7).alias("b"), times.bucket(F.col("ts"), None).alias("n"), times.bucket(F.col("ts"), 0).alias("z")).where("ts > -9223372036854775800").collect()
    assert all(r.b == r.ts // 7 and r.n is None and r.z is None for r in got)


def test_ranks_by_slices(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.randrange(-500, 500), i) for i in range(400)]
    got = times.ranked(spark.createDataFrame(rows, "k string, ts long, id long"), ["k"], "ts", ["id"], 37).collect()
    for k in "abc":
        mine = sorted((t, i) for key, t, i in rows if key == k)
        assert [(r.ts, r.id) for r in sorted((r for r in got if r.k == k), key=lambda r: r.rn)] == mine
        assert {r.n_of_key for r in got if r.k == k} == {len(mine)}
