"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, decontam, minhash, mixing, oracles, pii, repetition, secrets, suffix_dedup, toxicity, url_rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = url_rules.mine(pages, table(spark, sf_dir, "labels"), F.expr("quality = 0 or toxic = 1"))
    return url_rules.judge_urls(pages, mined, keep=["page_id"])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("secret_spans", lambda s: ~s["linked"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined("secret_spans").alias("spans")
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("kept_text")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", F.expr("aggregate(hit_ranges, 0L, (a, r) -> a + r.end - r.first)").alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_ranges") > 0).alias("contaminated"),
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "base_failed", "kept"]
    return repetition.quality(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", *made)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("removed", "kept_text")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_table(documents, table(spark, sf_dir, "labels"))
    return toxicity.grade_texts(documents, model, keep=["doc_id"])


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("pii_spans")).alias("spans")
    )


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_source_mix": op3_source_mix,
    "op4_chunk_dedup": op4_chunk_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
