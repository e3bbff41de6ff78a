"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import decontamination, divergence, hamming, html_extract, mixing, ngram_join, packing, quality, secrets, sharding, substring, suffix_tree, valid_time


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of near-duplicate links of every document."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, as spans."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and verdict of every document."""
    return quality.report(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, calibrated probability, copies and decision of every document."""
    told = mixing.calibrate(_table(spark, sf_dir, "documents"))
    names = ("source", "lang", "topic", "tokens", "weight", "probability", "copies", "kept")
    return told.select("doc_id", *(told[f"m_{c}"].alias(c) for c in names))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest codes of every vector whose id is divisible by 20, among all."""
    vectors = _table(spark, sf_dir, "embeddings")
    return hamming.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document."""
    return suffix_tree.score(_table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeats of 35 words or more, removed from every document."""
    return substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("removed_spans")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that stand out in each."""
    return divergence.audit(_table(spark, sf_dir, "documents")).drop("p")


def op13_valid_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with their client's version at the time, and late changes."""
    return valid_time.enrich(_table(spark, sf_dir, "sales"), _table(spark, sf_dir, "client_changes")).drop("client_id")


_QUERIES = (op1_ngram_jaccard_join, op2_html_extraction, op3_sharding, op4_secret_scans, op5_quality_rules, op6_source_mixing, op7_packing, op8_exact_topk, op9_lm_scoring, op10_substring_dedup, op11_decontamination, op12_source_divergence, op13_valid_time)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": sharding.oracle(), "op8_exact_topk": hamming.ORACLE, "op11_decontamination": decontamination.ORACLE, "op12_source_divergence": divergence.ORACLE}
