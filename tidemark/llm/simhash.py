"""SimHash near-dedup over a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 2 bits differ in at most 2 of
their 8 bytes: linked pairs share at least 6 positional bytes, the guaranteed
minimum. Posting lists of single positional bytes would hold a fixed part of all
fingerprints each, and their pairs grow with the square of the input. So a
fingerprint is posted under sets of 5 positional bytes, chosen so that whichever 2
bytes a pair differs in, some set leaves out both (11 sets do). In a posting the
shared positional bytes of each pair are tallied over all 8 positions, pairs that
reach 6 are retained, and these are verified by counting differing bits.

A posting of more than MOST_TALLIED fingerprints is not tallied pair by pair: its
fingerprints are posted again under 6 positional bytes each, where every pair has
the minimum, and 65,536 is the most that a posting can hold. There partners are
looked up among the 136 values of the free 16 bits at 1 or 2 bits' distance. The
links that leave a posting are a spanning forest of it, fewer than its
fingerprints. Components come from rounds of minimum labels with pointer jumping
over written tables.

Defined results: a null or wordless text has fingerprint 0 and is linked like
any other; a text of any length is read whole; a bit that is set in exactly half of
the hashes is 0; in groups, rows that repeat a doc_id are one document if their texts
agree, and link what they touch otherwise; a row without doc_id links what it
touches and gets its group's component id, the smallest doc_id, or null where the
group has none. Deduplication groups by texts alone: one row of each group stays,
that with the smallest doc_id, one without only where the group has none. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batch, discard, prepare, text_or_empty, wrapped, written

SHINGLE = 3
SEED = 42
MOST_BITS = 2
BYTES = 8
LEAST_SHARED = BYTES - MOST_BITS
MOST_TALLIED = 4096
TALLY_ROWS = 128  # fingerprints of a posting that are held against all others at a time


def _covering(size: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of this size, so that any MOST_BITS positions lie together in one; greedily few."""
    sets, wanted = list(combinations(range(BYTES), size)), set(combinations(range(BYTES), MOST_BITS))
    chosen = []
    while wanted:
        best = max(sets, key=lambda s: len(wanted.intersection(combinations(s, MOST_BITS))))
        chosen.append(best)
        wanted -= set(combinations(best, MOST_BITS))
    return chosen


OPEN = _covering(3)  # the byte positions that a posting leaves open
FREE = list(combinations(range(BYTES), MOST_BITS))  # those that a posting of a crowded posting leaves open

LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """bytes.lower and bytes.split know ASCII alone, which is the word rule of this operator."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(run), seed) for run in runs], "<u8")
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_of(text: Column) -> Column:
    """The fingerprint of a text as a signed long; a function from Arrow to Arrow."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts)).view(np.int64))

    return F.arrow_udf(run, "long")(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp."""
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), fingerprint_of(text_or_empty()).alias("fp"))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def posted(fps: DataFrame, open_sets: list[tuple[int, ...]]) -> DataFrame:
    """node, fp, posting, shared: the fingerprint without the bytes that the posting leaves open; sorted by posting."""
    free = [sum(0xFF << (8 * p) for p in positions) for positions in open_sets]
    posts = F.array(*[F.struct(F.lit(k).cast("long").alias("posting"), F.col("fp").bitwiseAND(F.lit(signed(~mask & (1 << 64) - 1))).alias("shared")) for k, mask in enumerate(free)])
    return fps.select("node", "fp", F.inline(posts)).repartition("posting", "shared").sortWithinPartitions("posting", "shared", "fp")


def tallied(fps: np.ndarray) -> list[tuple[int, int]]:
    """Pairs i < j of a posting's fingerprints (uint64) that share LEAST_SHARED positional bytes or more and differ in MOST_BITS bits or fewer."""
    found = []
    for at in range(0, len(fps), TALLY_ROWS):
        differ = np.ascontiguousarray(fps[at : at + TALLY_ROWS, None] ^ fps[None, at:])
        shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(np.triu(shared >= LEAST_SHARED, 1))
        near = np.bitwise_count(differ[i, j]) <= MOST_BITS
        found += zip((i[near] + at).tolist(), (j[near] + at).tolist(), strict=True)
    return found


def looked_up(values: np.ndarray) -> list[tuple[int, int]]:
    """Pairs i < j of distinct 16-bit values that differ in MOST_BITS bits or fewer."""
    table = np.full(1 << 16, -1, np.int32)
    table[values] = np.arange(len(values))
    found = []
    for mask in (m for m in range(1, 1 << 16) if m.bit_count() <= MOST_BITS):
        j = table[values ^ np.uint16(mask)]
        i = np.nonzero(j > np.arange(len(values)))[0]
        found.append(np.stack([i, j[i]], axis=1))
    return np.concatenate(found).tolist()


def forest(n: int, pairs) -> list[tuple[int, int]]:
    """As few of the pairs as connect what all of them connect."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    kept = []
    for i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((i, j))
            if len(kept) == n - 1:
                break
    return kept


def _postings(batches, most: int = MOST_TALLIED):
    """Postings of two rows or more from batches of (node, fp, posting, shared), sorted; one of more than `most` rows may come in parts, told by False."""
    held = np.zeros((0, 4), np.int64)
    crowded = None  # the posting that is coming in parts
    for batch in batches:
        rows = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        cuts = np.nonzero((rows[1:, 2:] != rows[:-1, 2:]).any(axis=1))[0] + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
        if len(cuts) and crowded is not None:
            if tuple(rows[0, 2:]) == crowded:
                yield rows[: ends[0]], False
                begins, ends = begins[1:], ends[1:]
            crowded = None
        several = ends[:-1] - begins[:-1] > 1
        for b, e in zip(begins[:-1][several].tolist(), ends[:-1][several].tolist(), strict=True):
            yield rows[b:e], e - b <= most
        held = rows[begins[-1] :]
        if len(held) > most or tuple(held[0, 2:]) == crowded:
            crowded = tuple(held[0, 2:])
            yield held, False
            held = held[:0]
    if len(held) > 1:
        yield held, True


def _links(rows: np.ndarray, pairs) -> dict:
    kept = forest(len(rows), pairs)
    i, j = (np.array([p[k] for p in kept], np.int64) for k in (0, 1))
    return {"a": rows[i, 0], "b": rows[j, 0]}


def links(fps: DataFrame, most_tallied: int = MOST_TALLIED) -> DataFrame:
    """Links a, b between nodes whose fingerprints differ in 1 or 2 bits, enough to connect all that are connected.

    fps: node and fp, distinct in fp.
    """
    prepare(fps.sparkSession)
    schema = pa.schema([*LINK, ("node", pa.int64()), ("fp", pa.int64())])

    def tally(batches):
        found, n = [], 0

        def linked():
            a, b = (np.concatenate([f[k] for f in found]) for k in "ab")
            none = [None] * len(a)
            return arrow_batch({"a": a, "b": b, "node": none, "fp": none}, schema)

        for rows, whole in _postings(batches, most_tallied):
            if not whole:
                none = [None] * len(rows)
                yield arrow_batch({"a": none, "b": none, "node": rows[:, 0], "fp": rows[:, 1]}, schema)
                continue
            pairs = tallied(rows[:, 1].view(np.uint64))
            if pairs:
                found.append(_links(rows, pairs))
                n += len(found[-1]["a"])
            if n >= MOST_TALLIED:
                yield linked()
                found, n = [], 0
        if n:
            yield linked()

    def look_up(batches):
        # A posting is held whole: it has 65,536 fingerprints at most.
        held: list[np.ndarray] = []
        for rows, _ in _postings(batches, most_tallied):
            if held and tuple(held[0][0, 2:]) != tuple(rows[0, 2:]):
                yield close(np.concatenate(held))
                held = []
            held.append(rows)
        if held:
            yield close(np.concatenate(held))

    def close(rows: np.ndarray):
        lo, hi = (rows[:, 1].view(np.uint64) >> np.uint64(8 * p) & np.uint64(255) for p in FREE[int(rows[0, 2])])
        return arrow_batch(_links(rows, looked_up((lo | hi << np.uint64(8)).astype(np.uint16))), LINK)

    first = written(posted(fps, OPEN).mapInArrow(tally, "a long, b long, node long, fp long"), "postings")
    crowded = first.where("node IS NOT NULL").select("node", "fp").distinct()
    again = posted(crowded, FREE).mapInArrow(look_up, "a long, b long")
    return first.where("node IS NULL").select("a", "b").union(again)


def components(pairs: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for each node of pairs (a, b)."""
    edges = written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = written(edges.union(edges.select("b", "a")), "edges-both")
    held = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("next")), "labels")
    while True:
        labels = held.select("node", F.col("next").alias("label"))
        # the smallest label next to each node, then the label that that label's own node has
        seen = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = written(labels.join(seen, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("next")), "labels-hooked")
        jump = hooked.select(F.col("node").alias("_node"), F.col("next").alias("_next"))
        moved = written(hooked.join(jump, F.col("next") == F.col("_node")).select("node", "label", F.least("next", "_next").alias("next")), "labels")
        discard(held, hooked)  # moved has all that they told
        held = moved
        if not moved.where("next <> label").limit(1).count():
            discard(edges, both)
            return moved.select("node", F.col("next").alias("label"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs."""
    prints = written(fingerprints(docs), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")).withColumn("node", F.col("fp")), "nodes")
    same_id = prints.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    repeats = same_id.select("doc_id", F.col("lo").alias("a")).join(prints, "doc_id").select("a", F.col("fp").alias("b")).distinct()
    labels = components(links(nodes).union(repeats))
    labelled = written(nodes.join(labels, "node", "left").select("fp", "least_id", F.coalesce("label", "node").alias("label")), "labelled")
    ids = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = written(labelled.join(ids, "label").select("fp", "component_id"), "named")
    # read from tables and shuffled by this join alone: adaptive execution can split a hot fingerprint
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of linked texts, that with the smallest doc_id, with the columns they came with.

    Rows that tie in doc_id and text are told apart by the row's place, so exactly
    one stays. Texts are written once with their fingerprints and shuffled once, by
    place, which no two rows share: groups are made of fingerprints alone.
    """
    prepare(docs.sparkSession)
    rows = written(wrapped(docs).select("row", F.monotonically_increasing_id().alias("place"), fingerprint_of(text_or_empty("row.text")).alias("fp")), "near-rows")
    best = F.min(F.struct(F.col("row.doc_id").isNull().alias("no_id"), F.col("row.doc_id").cast("long").alias("doc_id"), "place")).alias("best")
    nodes = written(rows.groupBy("fp").agg(best).withColumn("node", F.col("fp")), "nodes")
    labels = components(links(nodes))
    groups = nodes.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("best").alias("best"))
    kept = groups.select(F.col("best.place").alias("place"))
    return rows.join(kept, "place", "left_semi").select("row.*")
