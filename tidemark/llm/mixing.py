"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

A source's target is its weight's share of the wanted words, at most `cap` times
what it has; the excess is shared again by weight (water filling, solved in
closed form over the sources in order of capacity per weight). Documents are
dealt by a seeded hash to shards of about `shard_rows` rows. In each shard the
wanted blocks of `block_words` words go to the sources by highest quotients
t / (2k + 1). A divisor near T / M reproduces that, so only the quotients within
n / 2 seats of each quota compete and every lower one is granted outright: a few
candidates for each source and shard, whatever the number of blocks. What
rounding to blocks and the cap leave of a source's target over all shards, above or
below, is settled in words, shard after shard in their seeded order, so every source
gets its target to the word, however few words it has in a shard. A shard's
documents of a source, in seeded order, form the line of its blocks; the quota
takes the line as often as it fits and then its first blocks again.

Defined results: a null text has size 0 and is never taken; the null source is
one source, after all others; an empty table gives an empty result; repeated
rows are documents of their own, and rows without doc_id, or of a doc_id that more
than a shard's rows share, are dealt by their place in the table; a text of any
length may be cut between words; equal quotients go by source, then by divisor;
equal keys stand by doc_id, then size; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, WORD, text_or_empty, word_count, wrapped, written

WEIGHTS = (3, 1, 2)
SHARE_HALVES = 3  # wanted words, in halves of all words
CAP = 2
BLOCK_WORDS = 32
SHARD_ROWS = 2000
SEED = "mix-1"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and row, which tells equal rows apart."""
    return docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), F.monotonically_increasing_id().alias("row"))


def keyed(sized: DataFrame, shard_rows: int = SHARD_ROWS, seed: str = SEED) -> DataFrame:
    """sized with key, by which rows are dealt and stand in line. What is joined has a row for shard_rows rows at most."""
    crowded = sized.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_n")).where(F.col("_n") > shard_rows)
    row = F.concat(F.lit("row "), F.col("row").cast("string"))
    name = F.when(F.col("_n").isNotNull(), F.concat(F.col("doc_id").cast("string"), row)).otherwise(F.coalesce(F.col("doc_id").cast("string"), row))
    return sized.join(crowded, F.col("doc_id") == F.col("_id"), "left").withColumn("key", F.md5(F.concat(F.lit(seed + ":"), name))).drop("_id", "_n")


def targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, share_halves: int = SHARE_HALVES, cap: int = CAP) -> DataFrame:
    """source, source_size, target: one row for each source."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*map(F.lit, weights))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("long"))
    by_room = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy()
    before, after = by_room.rowsBetween(W.unboundedPreceding, -1), by_room.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(every)
    left = share_halves * total - 2 * cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    full = 2 * cap * F.col("source_size") * F.sum("weight").over(after) <= left * F.col("weight")
    sources = sources.withColumn("total", total).withColumn("full", full)
    capped = F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    level = F.col("weight") * (share_halves * F.col("total") - 2 * cap * capped) / (2 * open_weight).cast("double")
    return sources.select("source", "source_size", F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(level).alias("target"))


def quotas(sized: DataFrame, wanted: DataFrame, block_words: int = BLOCK_WORDS, cap: int = CAP) -> DataFrame:
    """source, shard, words (there), demand (words to take there), source_size, target."""
    cells = sized.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    w = wanted.withColumnRenamed("source", "_source")
    cells = cells.join(w, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    cells = cells.withColumn("t", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0))
    shard = W.partitionBy("shard")
    blocks = F.floor(F.sum("t").over(shard) / block_words + 0.5)
    cells = cells.withColumn("blocks", blocks).withColumn("sum_t", F.sum("t").over(shard)).withColumn("n", F.count("*").over(shard))
    portion = F.when(F.col("sum_t") > 0, F.col("t") / F.col("sum_t")).otherwise(0.0)
    cells = cells.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(portion * (F.col("blocks") - F.col("n") / 2)) - 1))
    cells = cells.withColumn("most", F.ceil(portion * (F.col("blocks") + F.col("n") / 2)) + 1)
    cells = cells.withColumn("open", F.col("blocks") - F.sum("sure").over(shard))
    seats = cells.select("source", "shard", "t", "open", F.explode(F.sequence("sure", "most")).alias("k"))
    rank = F.row_number().over(W.partitionBy("shard").orderBy((F.col("t") / (2 * F.col("k") + 1)).desc(), F.col("source").asc_nulls_last(), "k"))
    won = seats.withColumn("rank", rank).where("rank <= open AND t > 0").groupBy(F.col("source").alias("_source"), F.col("shard").alias("_shard")).agg(F.count("*").alias("won"))
    cells = cells.join(won, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")), "left")
    demand = F.least((F.col("sure") + F.coalesce("won", F.lit(0))) * block_words, cap * F.col("words"))
    return cells.select("source", "shard", "words", demand.cast("long").alias("demand"), "source_size", "target")


def settled(quota: DataFrame, cap: int = CAP) -> DataFrame:
    """quotas() with each source's demand brought to its target: shards in order give room, or give back, until it is met."""
    source = W.partitionBy("source")
    before = source.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    q = quota.withColumn("left", F.floor(F.col("target") + 0.5) - F.sum("demand").over(source)).withColumn("room", cap * F.col("words") - F.col("demand"))
    q = q.withColumns({"room_before": F.coalesce(F.sum("room").over(before), F.lit(0)), "held_before": F.coalesce(F.sum("demand").over(before), F.lit(0))})
    more = F.greatest(F.lit(0), F.least(F.col("room"), F.col("left") - F.col("room_before")))
    less = F.greatest(F.lit(0), F.least(F.col("demand"), -F.col("left") - F.col("held_before")))
    return q.withColumn("demand", (F.col("demand") + more - less).cast("long")).drop("left", "room", "room_before", "held_before")


def mix(sized: DataFrame, weights: Sequence[int] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The rows of sized() with source_size, target, taken. sized should be a written table, since it is read several times."""
    shards = max(1, -(-sized.count() // shard_rows))
    dealt = keyed(sized, shard_rows).withColumn("shard", F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards)
    quota = written(settled(quotas(dealt, written(targets(sized, weights), "mix-targets"), block_words)), "mix-quotas")
    q = quota.withColumnRenamed("source", "_source").withColumnRenamed("shard", "_shard")
    line = W.partitionBy("source", "shard").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    placed = placed.join(q, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    times = F.when(F.col("words") > 0, F.expr("demand div words")).otherwise(F.lit(0)).cast("long")
    rest = F.col("demand") - times * F.col("words")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("begin") + F.col("size"), rest) - F.col("begin"))
    return placed.withColumn("taken", times * F.col("size") + part)


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    return mix(written(sizes(docs), "mix-sizes"), weights, block_words, shard_rows).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The mix itself: each row as often as it is taken; one that a block boundary cuts comes with its first words, white space as it was.

    A cut row's n_chars, where the table has such a column and the row a value, is its new length.
    """
    rows = written(wrapped(docs).withColumn("key", F.monotonically_increasing_id()), "mix-rows")
    sized = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), word_count(text_or_empty("row.text")).alias("size"), F.col("key").alias("row"))
    taken = written(mix(written(sized, "mix-sizes"), weights, block_words, shard_rows).select(F.col("row").alias("key"), "taken", "size").where("taken > 0"), "mix-taken")
    copies = F.transform(F.sequence(F.lit(0).cast("long"), F.expr("(taken - 1) div size")), lambda k: F.least(F.col("size"), F.col("taken") - k * F.col("size")))
    drawn = rows.join(taken, "key").select("row", "size", F.explode(copies).alias("take"))
    whole = F.col("take") == F.col("size")
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(SPACES + "*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("take").cast("int")), "")
    drawn = drawn.select("row", whole.alias("whole"), F.when(whole, F.col("row.text")).otherwise(cut).alias("text"))
    own = {f.name: F.col("row")[f.name] for f in docs.schema.fields}
    if "n_chars" in own:
        shorter = F.length("text").cast(docs.schema["n_chars"].dataType)
        own["n_chars"] = F.when(F.col("whole") | own["n_chars"].isNull(), own["n_chars"]).otherwise(shorter)
    return drawn.select(*[(F.col("text") if c == "text" else value).alias(c) for c, value in own.items()])
