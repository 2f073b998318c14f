"""From raw documents to packed training sequences: quality, near copies, repeated passages, test items, packing.

Every stage reads the whole table that the stage before it left. Columns of documents stay as they are but for text and
n_chars, which the third stage renews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.llm import decontaminate, minhash, packing, quality, substring
from evloom.llm.queries import fold, table
from evloom.llm.scratch import keep


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.3 or more; it learns from the labels outside the held-out fold."""
    model = quality.learn(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return quality.score(docs, model, "_quality").filter("_quality >= 0.3").drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near copies (five-word shingles, likeness 0.85)."""
    return minhash.first_of_each(docs, 85)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that an earlier document has; those left without a word go."""
    out = substring.dedup_windows(docs, 13, "_dedup").filter("_dedup.n_removed = 0 or _dedup.n_removed < _dedup.n_words").drop("_dedup")
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of 1024 tokens."""
    return packing.pack(docs, 1024)


STAGES = [("quality classifier", quality_filter), ("near dedup", near_dedup), ("substring dedup", substring_dedup), ("decontamination", decontamination), ("packing", pack)]

#: No stage's learned or hashed decisions can be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
