"""Ranked findings and report documents.

Top-k queries filter a row number, which Spark turns into a limit per group before the shuffle, so a hot
repository sends k rows per task. Counts that go with them come from an aggregate, never from a window over
all findings. Nothing unbounded is gathered into one row: a report is one small document per repository plus
one JSON line per finding.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.dimensions import categories_df, fix_guides_df, rules_df, severities_df
from ..catalog.rules import DEFAULT_RULES, Rule
from ..functions.values import exact_round, location
from .scan import Outputs, scan_tables
from .scoring import category_scores, finish_scores, language_breakdown, repo_stats, rule_counts, rule_scores, with_severity

TOP_FINDINGS = 15
TOP_RULES = 8
FINDINGS_PER_RULE = 25


def _finding_order() -> list:
    """Severity first, then place; column and rule id make the order total."""
    return [F.desc("severity"), F.asc("path"), F.asc("line"), F.asc("column"), F.asc("rule_id"), F.asc("snippet")]


def _shown(name: str, chars: int | None):
    return F.col(name) if chars is None else F.substring(name, 1, chars).alias(name)


def label_violations(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Findings with severity and category labels; unknown values show as they are."""
    spark = found.sparkSession
    labelled = (
        with_severity(found, rules, "left")
        .join(F.broadcast(severities_df(spark)), "severity", "left")
        .join(F.broadcast(categories_df(spark).select("category", "label")), "category", "left")
    )
    return labelled.withColumns({
        "severity_label": F.coalesce("severity_label", F.col("severity").cast("string")),
        "category_label": F.coalesce("label", "category"),
    }).drop("label")


def violations_with_fix(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """Findings of known rules with the guide to fix them (null without a guide)."""
    guides = fix_guides_df(found.sparkSession)
    return with_severity(found, rules).join(F.broadcast(guides), "rule_id", "left")


def sorted_violations(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """All findings of known rules in report order, by repository. The sort is a range partitioning on the full
    key, so the findings of one large repository spread over many tasks."""
    return with_severity(found, rules).orderBy(F.asc("repo_id"), *_finding_order())


def top_violations(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: int = TOP_FINDINGS, snippet_chars: int | None = None) -> DataFrame:
    """The first ``k`` findings of each repository; unknown rules count as severity 0. ``snippet_chars`` shortens lines
    for display."""
    ranked = with_severity(found, rules, "left").withColumn("severity", F.coalesce("severity", F.lit(0)))
    window = Window.partitionBy("repo_id").orderBy(*_finding_order())
    return (
        ranked.withColumn("rank", F.row_number().over(window))
        .filter(F.col("rank") <= k)
        .select(
            "repo_id", "rank", "rule_id", "severity", location("path", "line").alias("location"),
            _shown("snippet", snippet_chars),
        )
    )


def top_rules(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: int = TOP_RULES, name_chars: int | None = None) -> DataFrame:
    """The first ``k`` rules of each repository by penalty; ``name_chars`` shortens names for display."""
    return (
        rule_scores(found, rules)
        .filter(F.col("rank") <= k)
        .select("repo_id", "rank", "rule_id", _shown("name", name_chars), "severity", "count", "penalty")
    )


def top_per_rule(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: int = FINDINGS_PER_RULE) -> DataFrame:
    """The first ``k`` findings of every rule in every repository, with how many more there are."""
    known = with_severity(found, rules)
    window = Window.partitionBy("repo_id", "rule_id").orderBy(
        F.asc("path"), F.asc("line"), F.asc("column"), F.asc("snippet")
    )
    shown = known.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)
    return shown.join(rule_counts(found), ["repo_id", "rule_id"]).select(
        "repo_id", "rule_id", "rank", location("path", "line").alias("location"), "snippet", "count",
        F.greatest(F.col("count") - k, F.lit(0)).alias("others"),
    )


def rule_catalog(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """The catalogue by category, in catalogue order, with how often each rule fired in the corpus."""
    spark = found.sparkSession
    counts = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    listed = (
        rules_df(spark, rules).join(counts, "rule_id", "left")
        .join(F.broadcast(severities_df(spark)), "severity", "left")
        .na.fill(0, ["findings"])
    )
    rows = listed.groupBy("category").agg(
        F.array_sort(F.collect_list(F.struct("rule_id", "name", "severity", "severity_label", "findings"))).alias("rules")
    )
    return rows.join(F.broadcast(categories_df(spark)), "category").select(
        "ord", "category", "label", "color", "rules"
    )


def catalog_integrity(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """What the catalogue lacks for the findings at hand: rule ids without a rule or without a guide, and guides
    without a rule."""
    spark = found.sparkSession
    seen = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("findings"))
    known = F.broadcast(rules_df(spark, rules).select("rule_id"))
    guides = F.broadcast(fix_guides_df(spark).select("rule_id"))
    no_rule = seen.join(known, "rule_id", "left_anti").withColumn("problem", F.lit("no rule"))
    no_guide = seen.join(guides, "rule_id", "left_anti").withColumn("problem", F.lit("no guide"))
    orphan = fix_guides_df(spark).select("rule_id").join(known, "rule_id", "left_anti").select(
        "rule_id", F.lit(0).cast("bigint").alias("findings"), F.lit("guide without rule").alias("problem")
    )
    return no_rule.unionByName(no_guide).unionByName(orphan).select("problem", "rule_id", "findings")


def report_documents(
    stats: DataFrame, found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: float = 1.0
) -> DataFrame:
    """One JSON document per repository: score, category and rule tables, file statistics.

    Every nested list is bounded by the catalogue (categories, rules) or by the language list.
    """
    rules = tuple(rules)
    # All three start from the same counts, whose shuffle Spark runs once.
    totals = rule_counts(found).groupBy("repo_id").agg(F.sum("count").alias("total_violations"))
    categories = category_scores(found, rules).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "category", "label", "color", "count", "penalty",
            exact_round(F.col("percent_of_penalty"), 1).alias("percent_of_penalty"),
        ))).alias("categories"),
        F.sum("penalty").alias("penalty"),
    )
    by_rule = rule_scores(found, rules).groupBy("repo_id").agg(
        F.array_sort(F.collect_list(F.struct(
            "rank", "rule_id", "name", "category", "severity", "count", "penalty"
        ))).alias("rules")
    )
    languages = language_breakdown(stats).groupBy("repo_id").agg(
        F.sort_array(F.collect_list(F.struct("code_lines", "language")), asc=False).alias("languages")
    )
    joined = (
        repo_stats(stats).join(totals, "repo_id", "left").join(categories, "repo_id", "left")
        .join(by_rule, "repo_id", "left").join(languages, "repo_id", "left")
        .na.fill(0, ["total_violations", "penalty"])
    )
    full = finish_scores(joined, k)

    def listed(name: str, fields: tuple[str, ...]):
        items = F.transform(F.col(name), lambda e: F.struct(*(e[f].alias(f) for f in fields)))
        return F.coalesce(items, F.array()).alias(name) if name != "languages" else items

    breakdown = F.map_from_entries(F.transform(
        F.coalesce("languages", F.array().cast("array<struct<code_lines:bigint,language:string>>")),
        lambda e: F.struct(e["language"], e["code_lines"]),
    ))
    document = F.struct(
        F.col("repo_id").cast("string").alias("repository"),
        F.struct(
            "score", "grade", "grade_color", "grade_label", "penalty",
            exact_round(F.col("density"), 2).alias("density"),
            F.col("total_code_lines").alias("code_lines"),
            "total_violations",
            exact_round(F.col("kwh"), 2).alias("illustrative_kwh"),
            exact_round(F.col("kg_co2"), 2).alias("illustrative_kg_co2"),
            listed("categories", ("category", "label", "color", "count", "penalty", "percent_of_penalty")),
            listed("rules", ("rule_id", "name", "category", "severity", "count", "penalty")),
        ).alias("index"),
        F.struct(
            "total_files", "code_files", "total_code_lines", breakdown.alias("language_breakdown")
        ).alias("stats"),
    )
    return full.select("repo_id", F.to_json(document).alias("document"))


def report_findings(found: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """One JSON line per finding. An unknown rule is named by its id, without category and severity."""
    joined = with_severity(found, rules, "left")
    line = F.struct(
        "rule_id", F.coalesce("name", "rule_id").alias("rule_name"), "category", "severity", "path", "line", "column",
        "message", "snippet",
    )
    return joined.select("repo_id", F.to_json(line, {"ignoreNullFields": "false"}).alias("finding"))


def _report_outputs(
    stats: DataFrame, found: DataFrame, errors: DataFrame, rules: Iterable[Rule], k: float
) -> dict[str, DataFrame]:
    rules = tuple(rules)
    return {
        "repositories": report_documents(stats, found, rules, k),
        "findings": report_findings(found, rules),
        "report_errors": errors.select("repo_id", F.to_json(F.struct("path", "message")).alias("error")),
    }


def write_report(
    stats: DataFrame, found: DataFrame, errors: DataFrame, path: str, rules: Iterable[Rule] = DEFAULT_RULES,
    k: float = 1.0, buckets: int = 64,
) -> int:
    """Writes ``repositories``, ``findings`` and ``report_errors`` below ``path`` as JSON lines and commits them together;
    returns the version. The three inputs should be stored tables: each output reads them again (:func:`write_run` stores
    the scan itself). Read an output with ``read_committed(spark, path, name, fmt="json")``."""
    outputs = Outputs(stats.sparkSession, path, buckets)
    outputs.write(_report_outputs(stats, found, errors, rules, k), "json")
    return outputs.commit()


def write_run(
    scanned: DataFrame, path: str, rules: Iterable[Rule] = DEFAULT_RULES, k: float = 1.0, buckets: int = 64
) -> int:
    """All outputs of one scan below ``path``, visible at once: the tables of ``write_tables`` as Parquet and those of
    :func:`write_report` as JSON lines. A lazy scan runs once, and every output is made from what it stored: the reports from
    the flat tables, of which each reads a few columns, where the stored scan would give whole findings."""
    outputs = Outputs(scanned.sparkSession, path, buckets)
    tables = outputs.write(scan_tables(outputs.store("scanned", scanned)))
    outputs.write(_report_outputs(*tables.values(), rules, k), "json")
    return outputs.commit()
