"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, packing, each over all that came before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import mixing, neardup, packing, pii, quality
from tilewright.llm.common import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that fail the base rules, or a graded rule as strictly as their host's verdict holds it."""
    measures = durable(quality.measured(docs), "quality")  # measured once, for hosts and for documents
    return quality.judged(measures, durable(quality.host_rates(measures), "hosts")).where("kept").select(COLUMNS)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one whose id names the group."""
    return neardup.deduplicated(docs, percent=80).select(COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled towards the target shares of sources, languages and topics."""
    return mixing.mixed(durable(mixing.measured(docs), "measured")).where("sampled").select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their token ids and places in training sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", neardup_stage),
    ("personal data", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: No SQL: signatures, boosted trees and tokenizers have no form there; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
