"""The corpus pipeline: quality rules, near-dedup, decontamination, PII, source mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what the next
stage reads. All but the last return the columns of documents. Very long texts are read whole;
repeated rows are rows of their own; extra columns stay, whatever their names; empty tables give
empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubiform.llm import decontam, minhash, mixing, pii, repetition, store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality rules reject: null, empty and blank texts, and repetitive ones."""
    return repetition.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group; texts without words and rows without an id stay."""
    return minhash.drop_near(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages out; drops documents that are mostly made of them; null and empty texts stay."""
    return _measured(decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by the name of its kind; null and empty texts stay as they are."""
    return _measured(pii.redact(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document; documents it doesn't reach, and texts without words, stay with 0."""
    return mixing.mix_sources(docs, keep=("lang", "source"))


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the texts as they are now; null texts keep theirs."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", redact_pii),
    ("source mixing", mix),
]

#: Sketch bands and hashed orders have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written out and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
