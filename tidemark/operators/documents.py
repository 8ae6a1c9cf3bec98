"""Versioned documents: append-only revisions, their current state, puts, deletes, and copying with forks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.times import ranked

KEY = ["kind", "name"]
CONTENT = ["kind", "name", "schema", "body"]
RESERVED = "tidemark."
ORD_SLICE = 1 << 16  # requests are numbered within slices of their ord, so no task orders all


def heads(docs: DataFrame) -> DataFrame:
    """The newest revision of each document, deletions included."""
    return docs.groupBy(*KEY).agg(F.max_by(F.struct(*docs.columns), "id").alias("r")).select("r.*")


def current(docs: DataFrame, kind: str | None = None) -> DataFrame:
    """Documents as they are: the newest revision, unless it is a deletion."""
    docs = docs if kind is None else docs.where(F.col("kind") == kind)
    return heads(docs).where("body IS NOT NULL")


def kinds(docs: DataFrame) -> DataFrame:
    return current(docs).select("kind").distinct()


def history(docs: DataFrame, kind: str, name: str) -> DataFrame:
    return docs.where((F.col("kind") == kind) & (F.col("name") == name)).orderBy("id")


def judge(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """requests with `outcome` and the head that the first request of their document meets.

    requests: ord, action (put, put_if, delete), kind, name, schema, body,
    expected (a put_if's uuid of what should be current; null: nothing), and, where a
    document gets several, uuid, which the revision of a request would have. Requests
    of one document go by ord, and each meets what those before it left; without
    uuid each is judged against docs alone, so a document may have one request only.
    """
    h = heads(docs).select(*KEY, F.col("id").alias("head_id"), F.when(F.col("body").isNotNull(), F.col("uuid")).alias("head_uuid"))
    r = requests.join(h, KEY, "left")
    is_put = F.col("action") != "delete"
    refused = (
        F.when((F.col("kind") == "") | (F.col("name") == ""), "needs_key")
        .when(F.col("kind").startswith(RESERVED), "reserved")
        .when(is_put & (F.coalesce("schema", F.lit("")) == ""), "needs_schema")
        .when(is_put & F.col("body").isNull(), "not_json")
        .when(is_put & F.try_parse_json("body").isNull(), "not_json")
    )
    if "uuid" not in requests.columns:
        meets = F.when((F.col("action") == "put_if") & ~F.col("head_uuid").eqNullSafe(F.col("expected")), "conflict").when((F.col("action") == "delete") & F.col("head_uuid").isNull(), "absent")
        return r.withColumn("outcome", F.coalesce(refused, meets, F.when(is_put, "put").otherwise("deleted")))
    return _folded(r.withColumn("outcome", refused))


def _folded(r: DataFrame) -> DataFrame:
    """Judges what no rule of its own refused, a document's requests one after another. What put_if finds depends on every
    request before it, so a document is one task, which streams; documents spread over all.

    The window numbers the requests and keeps a document's together. A repartition() by KEY doesn't: Spark drops it
    after a join by KEY, and adaptive execution may then make that a broadcast join and read its shuffle by mapper.
    """
    ordered = r.withColumn("_nth", F.row_number().over(W.partitionBy(*KEY).orderBy("ord"))).sortWithinPartitions(*KEY, "ord")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            outcomes = []
            for nth, action, refused, expected, head, own in zip(*(batch[c] for c in ("_nth", "action", "outcome", "expected", "head_uuid", "uuid")), strict=True):
                if nth == 1:
                    now = head if isinstance(head, str) else None
                outcome = refused
                if not isinstance(refused, str):
                    if action == "put_if" and now != (expected if isinstance(expected, str) else None):
                        outcome = "conflict"
                    elif action == "delete":
                        outcome, now = ("absent", now) if now is None else ("deleted", None)
                    else:
                        outcome, now = "put", own
                outcomes.append(outcome)
            yield batch.drop(columns="_nth").assign(outcome=outcomes)

    return ordered.mapInPandas(run, r.schema)


def applied(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The revisions that judged requests add, in the order of ord; judged has uuid and created for them.

    Ids go on from the newest; a document's later requests supersede its earlier ones.
    """
    last = docs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    ok = judged.where(F.col("outcome").isin("put", "deleted"))
    deleted = F.col("outcome") == "deleted"
    numbered = ranked(ok, [], "ord", [], ORD_SLICE).crossJoin(last).withColumn("id", F.col("last") + F.col("rn"))  # one row
    before = F.coalesce(F.lag("id").over(W.partitionBy(*KEY).orderBy("ord")), "head_id")
    return numbered.select(
        "id", "uuid", *KEY, F.when(~deleted, F.col("schema")).alias("schema"), F.when(~deleted, F.col("body")).alias("body"), "created", before.alias("supersedes"),
    )


class DocumentConflict(ValueError):
    """Two archives hold a revision of one uuid with different content."""


def refuse(conflicts: DataFrame) -> None:
    """DocumentConflict if there is any."""
    first = conflicts.orderBy("uuid").limit(1).collect()
    if first:
        raise DocumentConflict(f"revision {first[0].uuid} of {first[0].kind}/{first[0].name} differs")


def jumped(pointers: DataFrame, columns: list[str]) -> DataFrame:
    """pointers (id, ...) with each of the columns followed to its end: ids that point to themselves.

    Pointers are doubled, so a line of n takes log2(n) rounds; each round is
    checkpointed, which bounds the plan and survives lost executors.
    """
    spark = pointers.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="tidemark-"))
    now = pointers.checkpoint()
    while True:
        step = now
        for c in columns:
            other = now.select(F.col("id").alias("_id"), F.col(c).alias("_next"))
            step = step.join(other, F.col(c) == F.col("_id")).withColumn(f"_{c}", F.col("_next")).drop("_id", "_next")
        step = step.checkpoint()
        moved = F.lit(False)
        for c in columns:
            moved = moved | (F.col(c) != F.col(f"_{c}"))
        more = step.where(moved).limit(1).count()
        now = step.select(*[F.col(f"_{c}").alias(c) if c in columns else F.col(c) for c in pointers.columns])
        if not more:
            return now


@dataclass(frozen=True)
class Copied:
    inserted: DataFrame  # revisions, as they go into the target
    conflicts: DataFrame  # revisions that both hold with different content: such a copy must not be made
    reported: Callable[[], DataFrame]

    @property
    def report(self) -> DataFrame:
        """kind, name, displaced, current, forked for each document that got a revision; runs the rounds of jumped()."""
        return self.reported()


def copy(src: DataFrame, dst: DataFrame, id_slice: int = 1 << 32) -> Copied:
    """Copies revisions that dst lacks, by uuid, in src's order, and tells which documents forked.

    A document forks when its earlier head in dst isn't among the ancestors of
    what now is newest: that head is displaced. A deletion is displaced only if
    the new line shares an ancestor that dst had.
    """
    d = dst.select(F.col("uuid"), F.col("id").alias("held_id"), *[F.col(c).alias(f"_{c}") for c in CONTENT])
    both = src.join(d, "uuid", "left")
    differs = F.lit(False)
    for c in CONTENT:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    conflicts = both.where(F.col("held_id").isNotNull() & differs).select("uuid", *KEY)

    # New ids follow src's order: counts of id slices give what lies before one, so no task orders all.
    new = both.where("held_id IS NULL").withColumn("_slice", F.floor(F.col("id") / id_slice))
    counts = new.groupBy("_slice").agg(F.count("*").alias("_n"))
    before = counts.select("_slice", F.coalesce(F.sum("_n").over(W.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    last = dst.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))
    numbered = new.withColumn("_own", F.row_number().over(W.partitionBy("_slice").orderBy("id"))).join(before, "_slice").crossJoin(last)  # one row
    numbered = numbered.withColumn("new_id", F.col("_last") + F.col("_before") + F.col("_own"))

    ids = numbered.select(F.col("id").alias("_src"), F.col("new_id").alias("_to")).union(both.where("held_id IS NOT NULL").select("id", "held_id"))
    inserted = numbered.join(ids, F.col("supersedes") == F.col("_src"), "left").select(F.col("new_id").alias("id"), "uuid", *CONTENT, "created", F.col("_to").alias("supersedes"))

    return Copied(inserted, conflicts, lambda: _forks(dst, inserted, last))


def _forks(dst: DataFrame, inserted: DataFrame, last: DataFrame) -> DataFrame:
    after = dst.select(*KEY, "id", "supersedes").union(inserted.select(*KEY, "id", "supersedes"))
    tops = inserted.groupBy(*KEY).agg(F.max_by(F.struct("id", "uuid"), "id").alias("top"))
    earlier = heads(dst).select(*KEY, F.struct("id", "uuid", F.col("body").isNull().alias("deleted")).alias("before"))
    touched = tops.join(earlier, KEY, "left")
    # A revision supersedes an earlier one, so ids fall along a line: from the top, the last one that isn't below the
    # earlier head is that head or the line passes it by; the last one that is new has an ancestor in dst or none.
    lines = after.join(touched.where("before IS NOT NULL").select(*KEY, F.col("before.id").alias("target")), KEY).crossJoin(last)  # one row
    up = F.when(F.col("supersedes") < F.col("id"), F.col("supersedes"))
    past = lambda floor: F.when(up >= floor, up).otherwise(F.col("id"))
    ends = jumped(lines.select("id", past(F.col("target")).alias("at_target"), past(F.col("_last") + 1).alias("at_new"), up.isNotNull().alias("has_up")), ["at_target", "at_new"])
    top = touched.where("before IS NOT NULL").select(*KEY, F.col("top.id").alias("id"), F.col("before.id").alias("target")).join(ends, "id")
    older = ends.select(F.col("id").alias("at_new"), F.col("has_up").alias("shares"))
    reach = top.join(older, "at_new").select(*KEY, (F.col("at_target") == F.col("target")).alias("reaches"), "shares")
    judged = touched.join(reach, KEY, "left")
    forked = F.col("before").isNotNull() & ~F.col("reaches") & (~F.col("before.deleted") | F.col("shares"))
    return judged.select(*KEY, F.when(forked, F.col("before.uuid")).alias("displaced"), F.col("top.uuid").alias("current"), forked.alias("forked"))
