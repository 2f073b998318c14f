"""The queries over the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(of: str, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null doc_id."""
    return F.crc32(F.col(of).cast("string")) % n


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    scored = quality.score(docs.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text"), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"), 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), 85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(table(spark, sf_dir, "documents")).drop("matches")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup_windows

    return dedup_windows(table(spark, sf_dir, "documents"), 13).select("doc_id", "dedup.n_words", "dedup.n_removed", "dedup.kept_sha256")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return langid.identify(docs, langid.learn(docs.filter("not held_out")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), 1024)


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    return lm.score(docs, ~F.col("held_out"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_suffix_array_dedup, op3_minhash_near_dedup, op4_license_scan, op5_substring_dedup, op6_document_fingerprints, op7_benchmark_decontamination, op8_language_id, op9_packing, op10_lm_scoring)}
#: The others learn, hash or tokenize, which SQL can't say; the tests hold them against brute force.
ORACLES = {"op2_suffix_array_dedup": oracles.SUBSTRINGS, "op3_minhash_near_dedup": oracles.NEAR, "op4_license_scan": oracles.LICENSES, "op5_substring_dedup": oracles.WINDOWS}
