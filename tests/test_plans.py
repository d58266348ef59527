"""What the plans must look like to hold at scale."""

import pytest

import codefootprint as cf
from codefootprint.catalog import select_rules
from workloads import oracles, registry

RANKED = ("top_violations", "top_per_rule")
RELATIONAL = (
    "missing_repo_errors", "admit_repos", "label_violations", "join_rules_inner", "join_rules_left",
    "violations_with_fix", "catalog_integrity", "repo_scores", "category_scores", "rule_scores", "quality_gate",
    "sorted_violations", "top_violations", "top_rules", "top_per_rule", "rule_catalog", "report_json",
    "report_findings", "usage_totals", "normalize_targets", "scan_requested",
)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, files_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("files"))
    files_of({"a.py": "print(1)\n", "b.js": "fetch(1)\n"}).write.mode("overwrite").parquet(path)
    return cf.read_corpus(spark, path)


def test_a_scan_moves_no_rows(stored):
    plan = plan_of(cf.scan_files(stored).select("repo_id", "findings"))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1
    found = plan_of(cf.violations(cf.scan_files(stored)))
    assert "Exchange" not in found and found.count("ArrowEvalPython") == 1
    errors = plan_of(cf.errors(cf.scan_files(stored)))
    assert errors.count("ArrowEvalPython") == 1


def test_scores_take_one_shuffle_of_partial_sums(stored):
    plan = plan_of(cf.scan_scores(cf.scan_files(stored)))
    assert plan.count("Exchange hashpartitioning(repo_id") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan and plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1


def test_unused_work_is_pruned(stored):
    stats = plan_of(cf.file_stats(cf.scan_files(stored)))
    assert "ArrowEvalPython" not in stats and "RLIKE" not in stats.split("Filter")[0]
    assets = plan_of(cf.violations(cf.scan_files(stored, select_rules(("GC070", "GC072")))))
    assert "ReadSchema: struct<repo_id:string,path:string,length:bigint>" in assets
    without = plan_of(cf.violations(cf.scan_files(stored, select_rules(registry.REGEX_IDS))))
    assert "ArrowEvalPython" not in without


@pytest.mark.parametrize("name", RANKED)
def test_ranked_lists_are_cut_before_the_shuffle(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert "WindowGroupLimit" in plan and "Partial" in plan


@pytest.mark.parametrize("name", RELATIONAL)
def test_no_cross_joins(spark, sf_dir, name):
    plan = plan_of(registry.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_query_has_a_counterpart():
    assert set(registry.QUERIES) == set(oracles.build())


def test_one_hot_repository_gives_the_same_scores(spark):
    """A repository with nearly all findings: totals and top lists stay whole."""
    found = spark.range(60_000).selectExpr(
        "IF(id % 100 = 0, id, 7) AS repo_id", "IF(id % 2 = 0, 'GC001', 'GC040') AS rule_id",
        "concat('f', lpad(id, 6, '0')) AS path", "1 AS line", "0 AS column", "'s' AS snippet", "'m' AS message",
    )
    stats = found.selectExpr("repo_id", "path", "'python' AS language", "10 AS code_lines", "1L AS bytes")
    hot = cf.repo_scores(stats, found).filter("repo_id = 7").collect()[0]
    assert hot.total_violations == 59_400 and hot.penalty == 29_400 * 3 + 30_000
    per_rule = cf.top_per_rule(found).filter("repo_id = 7").groupBy("rule_id", "count", "others").count().collect()
    assert {tuple(r) for r in per_rule} == {("GC001", 29_400, 29_375, 25), ("GC040", 30_000, 29_975, 25)}
