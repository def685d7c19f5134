"""The corpus pipeline: ``STAGES`` applied to documents in turn, each stage's result written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, exact_dedup, langid, pieces, simhash
from lodestar.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is recognised stay."""
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays."""
    return exact_dedup.distinct_texts(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest doc_id stays."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of any benchmark item go; the two items of op2's ``contaminated`` are that column's rule."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), least=1)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, with their number: (doc_id, ids, n_tokens)."""
    return pieces.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("decontamination", decontaminated), ("sentencepiece", encoded)]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
