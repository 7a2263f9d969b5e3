"""One query per operator over the test tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from custvalue.llm.decontamination import contaminated
from custvalue.llm.importance import resample
from custvalue.llm.jaccard_join import jaccard_components
from custvalue.llm.lexical_search import ranked_search
from custvalue.llm.license_scan import license_scan
from custvalue.llm.mixing import mix
from custvalue.llm.oracle import ORACLE
from custvalue.llm.packing import pack
from custvalue.llm.passage_dedup import repeated_passages
from custvalue.llm.quality_model import quality_scores
from custvalue.llm.quality_rules import quality_rules
from custvalue.llm.sharding import ring_shards
from custvalue.llm.suffix_dedup import remove_repeats
from custvalue.llm.toxicity import toxicity

__all__ = ["ORACLE", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in training sequences of 512 to 8192 tokens."""
    return pack(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.75 or more."""
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without 100-byte strings that start earlier, too."""
    found = remove_repeats(_table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain three quarters or more of a benchmark item's 5-word shingles."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards whose row counts differ by one at most."""
    return ring_shards(_table(spark, sf_dir, "documents"), shards=40).drop("home_shard")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices of every document."""
    return license_scan(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the clause grammar, learned outside the held-out fold."""
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by attention over its passages, learned outside the held-out fold."""
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return quality_rules(_table(spark, sf_dir, "documents"))


def op10_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, four fifths equal, that an earlier document has, too."""
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources by weights 5, 2, 1 takes."""
    found = mix(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", "cut")


def op12_term_pipeline_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of the highest lexical score for every benchmark item."""
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's words, and the tenth that is drawn by it."""
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_quality_model": op8_quality_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_passage_dedup": op10_passage_dedup,
    "op11_pivotal_mixing": op11_pivotal_mixing,
    "op12_term_pipeline_search": op12_term_pipeline_search,
    "op13_importance_resampling": op13_importance_resampling,
}
