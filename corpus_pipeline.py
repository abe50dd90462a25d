"""The corpus pipeline over `documents`: classify, drop near copies, mask secrets, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
stage's input; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import mixing, quality_model, secret_scan, segment, simhash
from barwright.llm.common import ship_package, table
from barwright.llm.queries import REGISTRY
from barwright.session import materialize


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of good quality is 0.3 or more; without labels it keeps all."""
    ship_package(spark)
    model = quality_model.fit(quality_model.describe(docs), table(spark, sf_dir, "labels"))
    x = quality_model.statistics_column(F.col("text"))
    return docs.where(quality_model.score_column(model, x) >= 0.3)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group whose fingerprints hang together by two bits or less."""
    ship_package(spark)
    return simhash.representatives(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; n_chars follows. Every document stays."""
    ship_package(spark)
    spans = materialize(secret_scan.find_spans(docs), "spans")
    masked = docs.withColumn("text", secret_scan.redact_column(secret_scan.learn_formats(spans), F.col("text")))
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents until each source has its target, up to three times each."""
    ship_package(spark)
    return mixing.sample(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with the scores of its three best segmentations."""
    ship_package(spark)
    return segment.encode_documents(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("encode_pieces", encode_pieces),
]

#: Trained models and connected components are beyond SQL; tests check the stages by brute force.
ORACLE_SQL = None


@REGISTRY.query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
