"""What the corpus operators share: the shared folder, written tables, Arrow slices.

White space is everywhere the class ``[\\x20\\x09-\\x0D]``; a word is a run of
anything else.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL_ROOTS: dict[str, str] = {}
_MADE: list[str] = []  # tables of written()
_STAGES: list[str] = []  # those of a pipeline's stages


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package when it isn't installed on them."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all machines share.

    Where the setting is absent, a local master gets a temporary folder; any
    other master is refused, since executors would not see such a folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        if context.applicationId not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        root = _LOCAL_ROOTS[context.applicationId]
    return f"{root.rstrip('/')}/tidemark-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Deletes what this application has written to the shared folder."""
    _delete(spark, shared_folder(spark))


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends here, and a lost executor loses nothing."""
    path = new_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    _MADE.append(path)
    return out


@contextmanager
def without_rule(spark: SparkSession, rule: str):
    """Plans made within the block are optimized without this rule."""
    key = "spark.sql.optimizer.excludedRules"
    held = spark.conf.get(key, None)
    spark.conf.set(key, ",".join(filter(None, [held, rule])))
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, held)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def roots(df: DataFrame) -> list[str]:
    """The folders and files that df is read from."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in leaf.relation().getClass().getSimpleName():
            found += leaf.relation().location().rootPaths().mkString("\n").split("\n")
    return found


@contextmanager
def stage_tables(spark: SparkSession, docs: DataFrame):
    """For one stage of a pipeline, whose stages run one after another: deletes the working tables of the stages before it, but for what docs is still read from."""
    used = [path.partition(":")[2].lstrip("/") for path in roots(docs)]
    for path in _STAGES.copy():
        if path.partition(":")[2].lstrip("/") not in used:
            _delete(spark, path)
            _STAGES.remove(path)
    before = len(_MADE)
    yield
    _STAGES.extend(_MADE[before:])


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later step reads."""
    for df in tables:
        _delete(df.sparkSession, df.written_to)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def wrapped(docs: DataFrame) -> DataFrame:
    """One column `row` that holds all of a document's, so no name of its own can clash; `row.*` gives them back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def word_count(text: Column) -> Column:
    """Words of a text, without building more than the split array."""
    parts = F.split(text, SPACES + "+")
    edge = lambda part: F.when(part == "", 1).otherwise(0)
    n = F.size(parts)
    ends = edge(F.element_at(parts, 1)) + F.when(n > 1, edge(F.element_at(parts, -1))).otherwise(0)
    return F.coalesce((n - ends).cast("long"), F.lit(0).cast("long"))


def slices(batches, rows: int = 1024, most_bytes: int = 4 << 20):
    """Arrow batches cut into pieces of bounded rows and bytes, which bounds what Python holds of long texts."""
    for batch in batches:
        size = sum((pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)), np.zeros(batch.num_rows, np.int64))
        ends, at = np.cumsum(size), 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right"))), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def arrow_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
