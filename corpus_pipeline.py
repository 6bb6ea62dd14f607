"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes
each stage's result to the shared folder and reads it again as the next one's input. All stages but
the last return the columns of ``documents``; line deduplication brings n_chars up to date. Every
stage takes texts of any length whole, rows of one doc_id by their texts, and extra columns of any
name along; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import decontaminate, langid, line_dedup, packing, simhash
from attesta.llm.common import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no known language: null, empty, without letters, or written unlike every
    language that is learned here. Equal rows stay or go together."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many share: the largest doc_id keeps them. A null text is one
    empty line, so it comes back empty."""
    rows = line_dedup.dedup_lines(docs)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return rows.select(*(changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id. Of equal rows one
    stays; null and empty texts are alike."""
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which a window of the benchmark occurs. Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, in sequences. A null or empty text is a piece of one id."""
    return packing.pack_first_fit(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SQL can't express the network of the first stage; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
