"""The queries and oracle SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .centroids import cluster_vectors
from .decontamination import find_contamination
from .html_extraction import extract_pages
from .jaccard_join import jaccard_components
from .license_scan import scan_licenses
from .mixing import mix_sources
from .pii import replace_pii
from .quality_rules import quality_rules
from .resampling import resample_to_target
from .sharding import shard_by_bytes
from .substring_dedup import dedup_substrings
from .toxicity import score_toxicity
from .weak_quality import classify_quality


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(_table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(_table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_to_target(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_html_extraction": op6_html_extraction,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_sharding": op9_sharding,
    "op10_pii": op10_pii,
    "op11_resampling": op11_resampling,
    "op12_clustering": op12_clustering,
    "op13_license_scan": op13_license_scan,
}

#: The learned operators, HTML and PII have no SQL; tests hold them against brute force or held-out labels.
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": oracles.MIXING,
    "op3_quality_rules": oracles.QUALITY_RULES,
    "op4_jaccard_join": oracles.JACCARD_JOIN,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_decontamination": oracles.DECONTAMINATION,
    "op9_sharding": oracles.SHARDING,
    "op11_resampling": oracles.RESAMPLING,
    "op12_clustering": oracles.CLUSTERING,
    "op13_license_scan": oracles.LICENSE_SCAN,
}
