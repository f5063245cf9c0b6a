"""The corpus pipeline: documents -> language ID -> toxicity -> near-duplicates -> decontamination -> mix.

Each stage works on what the one before kept, written as Parquet and read again. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstally.llm.common import long_rows, remove, shared_dir, table
from crosstally.session import on_workers
from crosstally.llm.decontaminate import decontaminated
from crosstally.llm.langid import fit_profiles, in_stated_language, learn_rule, predict_language
from crosstally.llm.mixing import mix
from crosstally.llm.simhash import first_of_each
from crosstally.llm.toxicity import THRESHOLD, toxicity_column, train_toxicity


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, texts that are like no learned language, and texts that are surely in another language than they state. Profiles and rule are learned from all rows."""
    long_rows(spark)
    profiles = fit_profiles(docs, max_docs_per_lang=None)
    rule = learn_rule(docs, profiles)
    return docs.filter(in_stated_language(F.col("lang").cast("string"), predict_language(F.col("text"), profiles), rule))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are toxic at any grade."""
    long_rows(spark)
    model = train_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_column(F.col("text"), model)["p_toxic"] < THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    long_rows(spark)
    return first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a window of a benchmark item."""
    long_rows(spark)
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document, and how many words that is."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [("language_id", language_id), ("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: Trained models and hash-based fingerprints can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote is deleted once the next one is written; the last stage's folder stays."""
    on_workers(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            remove(spark, before)
        before = f"{at}/{name}"
    return docs
