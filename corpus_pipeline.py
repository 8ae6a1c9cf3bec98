"""Prepares `documents` for training: five stages, each written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, language, mixing, packing, simhash
from tidemark.llm.common import prepare, stage_tables, table, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without text or letters, told with a score below 0.5, or explained too badly go (language.known_documents).

    Null and empty texts go; ties of scores go to the first language by name; repeated rows get equal
    answers; texts are read whole; with no labelled row all documents stay; an empty table stays empty.
    """
    prepare(spark)
    with stage_tables(spark, docs):
        return language.known_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then that with the smallest doc_id.

    A null text is the empty text; of rows that tie, repeated ones too, exactly one stays; texts are
    hashed whole; an empty table stays empty.
    """
    prepare(spark)
    with stage_tables(spark, docs):
        return exact_dedup.dedup_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links: that with the smallest doc_id, one without only where the group has none.

    Null and wordless texts are one group; of rows that tie, repeated ones too, exactly one stays;
    texts are read whole; an empty table stays empty.
    """
    prepare(spark)
    with stage_tables(spark, docs):
        return simhash.dedup_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; one that a block boundary cuts comes with its first words.

    Null and wordless texts are never taken; the null source is one source, after all others; repeated
    rows are documents of their own; ties go by source, doc_id and size; texts of any length count
    whole; an empty table stays empty.
    """
    prepare(spark)
    with stage_tables(spark, docs):
        return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length with their token ids.

    A null text gives the end id alone; repeated rows are packed as often as they come; pieces of equal
    length are numbered in the order of tasks; texts are encoded whole; an empty table stays empty.
    """
    prepare(spark)
    with stage_tables(spark, docs):
        return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL has no tokenizer, language model or SimHash; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
