"""64-bit hashes with wrap-around, which ANSI long arithmetic refuses: Python integers and numpy."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: FNV-1a's prime and offset basis, the second basis, the number of stagger buckets.
PRIME = 0x0000_0100_0000_01B3
BASIS = 0xCBF2_9CE4_8422_2325
SECOND_BASIS = 0x9E37_79B9_7F4A_7C15
STAGGER_BUCKETS = 64
MASK = (1 << 64) - 1
SECOND_PRIME = (PRIME << 17 | PRIME >> 47) & MASK
NO_STATE = (0, 0)


def stagger_bucket(stream: str, source_key: str) -> int:
    """Only the low six bits reach the bucket, so the hash is run modulo 64 with each byte's two high bits taken in too."""
    h = BASIS
    for byte in (*stream.encode(), 0xFF, *source_key.encode()):
        for part in (byte, byte >> 6):
            h = (h ^ part) * PRIME % STAGGER_BUCKETS
    return h % STAGGER_BUCKETS


def staggers_identically(a: str, b: str) -> bool:
    """Keys that differ in bit 5 alone, at an even number of places, share every bucket."""
    x, y = a.encode(), b.encode()
    differing = [p ^ q for p, q in zip(x, y, strict=False) if p != q]
    return len(x) == len(y) and all(d == 0x20 for d in differing) and len(differing) % 2 == 0


def source_key(labels: Column) -> Column:
    """key=value of a label map in key order, joined by U+0001."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\u0001")


def stagger(stream: str | Column, key: str | Column) -> Column:
    def buckets(streams: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([stagger_bucket(s, k) for s, k in zip(streams, keys, strict=True)])

    return F.pandas_udf(buckets, "int")(stream, key)


def fold_state(state: tuple[int, int], entries: Iterable[tuple[int, bytes]]) -> tuple[int, int]:
    """The running state of an index after more entries (ts, blob); never the state of no index."""
    a, b = (BASIS, SECOND_BASIS) if state == NO_STATE else state
    for ts, blob in entries:
        for byte in ts.to_bytes(8, "little", signed=True) + blob:
            a, b = (a ^ byte) * PRIME & MASK, (b ^ byte) * SECOND_PRIME & MASK
        if (a, b) == NO_STATE:
            a, b = 1, 0
    return a, b
