"""Exact dedup by a persistent digest index.

The index is a Parquet table bucketed and sorted by digest; the number of its
buckets is kept beside it and holds whatever the session's settings are. A batch of
documents is reduced to one row per digest (partial aggregation, so a digest that a
third of all rows share costs one row per task), anti-joined with the index by sort
merge without shuffling the index, and what is new is appended.

Defined results: a null text is the empty text, which is a text like any other; a
text of any length is hashed whole; of equal texts the longest original, then the
smallest doc_id stays (null doc_id last); of rows that tie in both, repeated ones
too, exactly one stays; nothing stays of a text that an earlier batch brought; other
columns are ignored whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, new_path, text_or_empty, without_rule, wrapped, written


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(text, SPACES + "+", ""), 256))


def text_digests(docs: DataFrame) -> DataFrame:
    """doc_id, digest (SHA-256 of the text without white space), n_points (code points of the text), and row, which tells equal rows apart."""
    text = text_or_empty()
    return docs.select("doc_id", _digest(text).alias("digest"), F.length(text).cast("long").alias("n_points"), F.monotonically_increasing_id().alias("row"))


class DigestIndex:
    """digest -> (keep_id, keep_points, keep_row, batch) at `path`; an index that exists there is opened with the buckets it has.

    `buckets` is the number for a new index. As a context manager it takes its
    name out of the catalog at the end; the files stay.
    """

    COLUMNS = "digest BINARY, keep_id BIGINT, keep_points BIGINT, keep_row BIGINT, batch STRING"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        state = f"{path}/_buckets"
        if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            self.buckets = spark.read.schema("buckets int").parquet(state).first().buckets
        else:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.range(1).select(F.lit(self.buckets).alias("buckets")).write.parquet(state)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        quoted = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {self.name} ({self.COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{quoted}'")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> "DigestIndex":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Groups whose digest the index lacks: a sort-merge anti-join that leaves the index where it lies."""
        return groups.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        (
            groups.select("digest", "keep_id", "keep_points", "keep_row", F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest")
            .mode("append").option("path", self.path).saveAsTable(self.name)
        )

    def compacted(self, path: str) -> "DigestIndex":
        """The index at another path, one file a bucket however many batches were appended."""
        other = DigestIndex(self.spark, path, self.buckets)
        rows = self.rows().repartition(self.buckets, "digest").sortWithinPartitions("digest")
        rows.write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", path).saveAsTable(other.name)
        return other

    def dedup(self, digests: DataFrame) -> DataFrame:
        """Adds the batch; doc_id, n_points, digest, row, keep_id, group_size (rows of the batch), kept for each of its rows."""
        batch = uuid.uuid4().hex
        best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("id"), F.negative("row").alias("row")))
        groups = digests.groupBy("digest").agg(best.alias("best"), F.count("*").alias("group_size"))
        groups = written(groups.select("digest", "group_size", F.bitwise_not("best.id").alias("keep_id"), F.col("best.n_points").alias("keep_points"), F.negative("best.row").alias("keep_row")), "digest-groups")
        self.append(self.unseen(groups), batch)
        own = F.when(F.col("batch") == batch, F.col("keep_row"))
        held = self.rows().select("digest", "keep_id", own.alias("keep_row"))
        decided = written(groups.select("digest", "group_size").join(held.hint("merge"), "digest"), "digest-decisions")
        # Both sides of this join are read from tables and shuffled by it alone, so adaptive execution can split a hot digest.
        return digests.join(decided, "digest").withColumn("kept", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))).drop("keep_row")


def exact_groups(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """One row per document with its group; the index is new unless index_path names one."""
    spark = docs.sparkSession
    digests = written(text_digests(docs), "digests")
    with DigestIndex(spark, index_path or new_path(spark, "digest-index")) as index:
        return index.dedup(digests)


def dedup_documents(docs: DataFrame, index_path: str | None = None) -> DataFrame:
    """The documents that stay, with the columns they came with.

    Rows are reduced to the one that stays of each digest before and after the
    only shuffle that carries texts; the index is joined where they then lie.
    """
    spark = docs.sparkSession
    text = text_or_empty("row.text")
    plain = [F.col("row")[f.name] for f in docs.schema.fields if not isinstance(f.dataType, T.MapType | T.ArrayType | T.StructType | T.VariantType)]
    marked = wrapped(docs).select("row", _digest(text).alias("digest"), F.length(text).cast("long").alias("points"), F.xxhash64(*plain).alias("tie"))
    order = F.struct("points", F.bitwise_not(F.col("row.doc_id")), "tie")
    best = marked.groupBy("digest").agg(F.max_by("row", order).alias("row"), F.max("points").alias("keep_points"))
    with DigestIndex(spark, index_path or new_path(spark, "digest-index")) as index:
        with without_rule(spark, "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"):  # it would join, and so shuffle, every copy before rows are reduced
            fresh = written(index.unseen(best), "fresh-documents")
        index.append(fresh.select("digest", F.col("row.doc_id").alias("keep_id"), "keep_points", F.lit(None).cast("long").alias("keep_row")), uuid.uuid4().hex)
    return fresh.select("row.*")
