"""Scores: penalties per repository, category and rule.

All of it is hash aggregation with a partial step before the shuffle, so a repository that holds a third of all
findings arrives as a few rows per task. Dimensions joined in are the fixed catalogue tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog.dimensions import categories_df, rules_df
from ..catalog.rules import CODE_LANGUAGES, DEFAULT_RULES, Rule
from ..functions.values import DEFAULT_K, MIN_KLOC, clamp_score, exact_round, grade_columns, impact_columns


def _spark(df: DataFrame) -> SparkSession:
    return df.sparkSession


def _is_code():
    return F.coalesce(F.col("language").isin(*CODE_LANGUAGES), F.lit(False))


def _stats_aggregates() -> list:
    return [
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(_is_code()).alias("code_files"),
        F.coalesce(F.sum(F.when(_is_code(), F.col("code_lines").cast("bigint"))), F.lit(0)).alias("total_code_lines"),
    ]


def repo_stats(stats: DataFrame) -> DataFrame:
    return stats.groupBy("repo_id").agg(*_stats_aggregates())


def language_breakdown(stats: DataFrame) -> DataFrame:
    """Lines per known language, code or not."""
    known = stats.filter(F.col("language").isNotNull())
    return known.groupBy("repo_id", "language").agg(F.sum(F.col("code_lines").cast("bigint")).alias("code_lines"))


def with_severity(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, how: str = "inner") -> DataFrame:
    """Findings with their rule's name, category and severity. The catalogue is a driver-side list of a few dozen
    rules, which is what allows the broadcast."""
    dimension = rules_df(_spark(found), rules).select("rule_id", "name", "category", "severity")
    return found.join(F.broadcast(dimension), "rule_id", how)


def _penalties(found: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Per repository: all findings, and the severity sum of those with a known rule."""
    return with_severity(found, rules, "left").groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("total_violations"),
        F.coalesce(F.sum(F.col("severity").cast("bigint")), F.lit(0)).alias("penalty"),
    )


def finish_scores(totals: DataFrame, k: float | Column = DEFAULT_K) -> DataFrame:
    """Adds density, score, grade and impact to per-repository totals."""
    lines = F.greatest(F.col("total_code_lines"), F.lit(1))
    kloc = F.greatest(lines / F.lit(1000.0), F.lit(MIN_KLOC))
    df = totals.withColumn("density", F.col("penalty") / kloc)
    df = df.withColumn("score", clamp_score(F.col("density"), k))
    return df.withColumns({**grade_columns(F.col("score")), **impact_columns(F.col("penalty"))})


def repo_scores(
    stats: DataFrame, found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: float = DEFAULT_K
) -> DataFrame:
    """Scores from a file table and a finding table; repositories without findings score 100.

    Both sides are one row per repository before they meet.
    """
    totals = repo_stats(stats).join(_penalties(found, rules), "repo_id", "left").na.fill(
        0, ["total_violations", "penalty"]
    )
    return finish_scores(totals, k)


def scan_scores(
    scanned: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: float = DEFAULT_K,
    requested: DataFrame | None = None,
) -> DataFrame:
    """Scores straight from a scan: one pass over the files, one shuffle of per-repository sums.

    ``requested`` repositories that have no file are scored too (100, as nothing was found).
    """
    totals = scan_totals(scanned, rules)
    if requested is not None:
        totals = requested.select("repo_id").distinct().join(totals, "repo_id", "left").na.fill(
            0, ["total_files", "code_files", "total_code_lines", "total_violations", "penalty"]
        )
    return finish_scores(totals, k)


def scan_totals(scanned: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Per repository: files, code lines, findings and the severity sum of those with a known rule."""
    weights = {r.id: r.severity for r in rules}
    table = F.create_map(*(F.lit(v) for pair in weights.items() for v in pair))
    penalty = F.aggregate(
        "findings",
        F.lit(0).cast("bigint"),
        lambda total, f: total + F.coalesce(F.try_element_at(table, f["rule_id"]), F.lit(0)),
    )
    return (
        scanned.select("repo_id", "language", "code_lines", F.size("findings").alias("_n"), penalty.alias("_p"))
        .groupBy("repo_id")
        .agg(*_stats_aggregates(), F.sum("_n").alias("total_violations"), F.sum("_p").alias("penalty"))
    )


def rule_counts(found: DataFrame) -> DataFrame:
    """Findings per repository and rule: the one aggregate over all findings that rankings start from."""
    return found.groupBy("repo_id", "rule_id").agg(F.count(F.lit(1)).alias("count"))


def category_scores(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Count, penalty and share per category. ``rank`` orders by penalty, ties in catalogue order."""
    per_category = with_severity(rule_counts(found), rules).groupBy("repo_id", "category").agg(
        F.sum("count").alias("count"), F.sum(F.col("count") * F.col("severity")).alias("penalty")
    )
    # At most ten rows per repository reach the windows.
    repo = Window.partitionBy("repo_id")
    share = F.col("penalty") / F.sum("penalty").over(repo) * 100.0
    return (
        per_category.join(F.broadcast(categories_df(_spark(found))), "category")
        .withColumn("percent_of_penalty", share)
        .withColumn("rank", F.row_number().over(repo.orderBy(F.desc("penalty"), "ord")))
        .select("repo_id", "category", "label", "color", "count", "penalty", "percent_of_penalty", "rank")
    )


def rule_scores(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Count and penalty per rule. ``rank`` orders by penalty, then count, ties by rule id."""
    rules = tuple(rules)
    scored = with_severity(rule_counts(found), rules).withColumn("penalty", F.col("count") * F.col("severity"))
    # At most one row per rule and repository reaches the window.
    order = Window.partitionBy("repo_id").orderBy(F.desc("penalty"), F.desc("count"), "rule_id")
    return scored.select(
        "repo_id", "rule_id", "name", "category", "severity", "count", "penalty",
        F.row_number().over(order).alias("rank"),
    )


def grade_scores(scores: DataFrame, column: str = "score") -> DataFrame:
    return scores.withColumns(grade_columns(F.col(column)))


def impact_estimate(penalties: DataFrame) -> DataFrame:
    """Illustrative kWh and kg CO2 of a ``penalty`` column, rounded for display."""
    return penalties.withColumns({
        name: exact_round(value, 2) for name, value in impact_columns(F.col("penalty")).items()
    })


def quality_gate(scores: DataFrame, min_score: float) -> DataFrame:
    """Repositories below the required score."""
    return scores.filter(F.col("score") < F.lit(float(min_score)))
