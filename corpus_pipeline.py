"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes all that its predecessor kept, and all but the last return the
columns of ``documents``, whatever the other columns are called. Rows of one doc_id with different texts are
different documents; equal rows are one after the near copies. Rows with a null doc_id are documents like any other (of like
texts, one with an id stays before one without). Null and empty texts are one group of copies. An empty table
passes through all stages.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from footgrid.llm import nbsvm_toxicity, pii_boost, simhash_bits, sos_packing, suffix_dedup
from footgrid.llm.common import new_folder


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text, if the table has both."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay."""
    return nbsvm_toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts alike by 0.8 in five-word shingles one document stays, that with the smallest id (ties: the smallest digest of the text, then of the other columns)."""
    return simhash_bits.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur more than once are taken out of the texts."""
    return _counted(suffix_dedup.without_repeats(docs, suffix_dedup.WORDS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return _counted(pii_boost.redacted(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return sos_packing.packed(docs)


#: Python workers are reused from stage to stage; with these they give arrays of over 4 MB back to the system at once,
#: where they would otherwise keep the most that any stage has used.
LEAN = {"MALLOC_MMAP_THRESHOLD_": "4194304", "MALLOC_TRIM_THRESHOLD_": "8388608", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def _lean(stage):
    """``stage`` with workers that give memory back; what the session sets itself stays."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in LEAN.items():
            spark.sparkContext.environment.setdefault(name, value)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("toxicity", _lean(toxicity)),
    ("simhash_near_dedup", _lean(near_duplicates)),
    ("suffix_array_dedup", _lean(repeated_passages)),
    ("pii", _lean(personal_data)),
    ("packing", _lean(packing)),
]

#: Stages of this kind cannot be written in SQL; tests/llm/test_pipeline.py holds the rows of all five against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
