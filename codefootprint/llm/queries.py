"""Registered queries of the operators, each over its whole tables, and the DuckDB statements of those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefootprint.llm import (
    boosting, centroids, decontamination, language, linededup, maxent, mixing, phrases, quality, simhash, substrings, tokencounts, toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_held_out(_table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_lines(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents")).drop("rest")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.count_tokens(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))
    numbers = F.transform("centroid", lambda x: x.cast("string"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join(numbers, ","), 256).alias("centroid_sha256"),
    )


def op13_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_maxent": op2_maxent,
    "op3_mix_sources": op3_mix_sources,
    "op4_simhash": op4_simhash,
    "op5_line_dedup": op5_line_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language": op7_language,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_token_counts": op10_token_counts,
    "op11_collocations": op11_collocations,
    "op12_centroids": op12_centroids,
    "op13_quality_trees": op13_quality_trees,
}

ORACLES = {
    "op3_mix_sources": mixing.MIX_SQL,
    "op5_line_dedup": linededup.LINE_SQL,
    "op11_collocations": phrases.PHRASE_SQL,
    "op12_centroids": centroids.CLUSTER_SQL,
}
