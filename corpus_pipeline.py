"""The corpus pipeline: quality filter, near-duplicate removal, substring removal, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last give back the columns of
documents. Between stages the rows are written as Parquet in the shared scratch folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import packing, quality, simhash, substring
from siltstone.llm.common import cut, release, scratch, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), most=4096, axes=32, neighbours=15)
    return quality.with_score(docs, model, score_col="_score").where("_score >= 0.3").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts whose five-word shingles have a Jaccard likeness of 0.8 or more stays, the one of least id
    (SimHash candidates, verified on the whole shingle sets)."""
    return simhash.keep_one(docs, width=5, similarity=0.8).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 50 words are cut out of all documents but the first. A text that loses nothing stays as it is; what
    remains of another has one space between words. A document that loses all its words stays with an empty text."""
    found = substring.remove_repeats(docs, window=50)
    left = found.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of what is left, in sequences of at most 1024 tokens."""
    pieces = packing.pack(docs, capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality_filter), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packed)]

#: SQL cannot vote by nearest neighbours or encode by BPE; tests/llm/test_pipeline.py holds the rows against a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage leaves behind goes once the next one has read it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            kept = keep(cut(stage(spark, docs, sf_dir)))
        if hasattr(docs, "_siltstone_path"):
            release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
