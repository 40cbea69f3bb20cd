"""A corpus from raw documents: each stage is one of the text operators and works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelforge.llm import decontaminate, near_dedup, pieces, pii, quality
from panelforge.llm.batches import ROWS
from panelforge.llm.queries import piece_model
from panelforge.streaming.storage import stored


def few_rows(spark: SparkSession) -> None:
    """The pipeline's setting of its session: a Python worker gets whole texts a few rows at a time, also where a stage's result is written later."""
    spark.conf.set(ROWS, "256")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or lie far from their language and source, go."""
    few_rows(spark)
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id.

    Documents are linked whose 64-bit fingerprints differ in at most 4 bits (blocks, as in op3). Fingerprints of texts at a Jaccard similarity of
    0.8 differ in 5 to 13 bits, and blocks that reach 13 bits are too short to select anything: those further copies agree in bands of
    MinHashes of five-word shingles, and each is verified on the whole sets.
    """
    few_rows(spark)
    return near_dedup.keep_one(docs, find=near_dedup.near_copies)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a test item go."""
    few_rows(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind."""
    few_rows(spark)
    return pii.redact(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: ids of each document and what they decode to."""
    few_rows(spark)
    done = pieces.pieces(docs.select("doc_id", "lang", "source", "text"), piece_model(), remembered=1 << 15)
    return done.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_tokens"), "pieces.ids", "pieces.decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("sentencepiece", sentencepiece),
]

#: Outliers, components and merges have no SQL form; ``tests/llm/test_pipeline.py`` states every stage in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between two stages is written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
