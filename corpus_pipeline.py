"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, ngram_join, packing, quality, secrets
from tidemark.llm.common import drop_table, shared_folder
from tidemark.session import ship


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    ship(spark)
    return ngram_join.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret in the text becomes <kind>."""
    ship(spark)
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("quality", keep_by_quality), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix), ("packing", pack)]

#: SQL cannot express the stages. Tests cover the operators they call; none runs the stages one after another.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = shared_folder(spark), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_table(spark, before)
        before = path
    return docs
