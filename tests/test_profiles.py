"""Rules as rows of a table, and repositories with rules and weights of their own."""

import re

import pytest

import codefootprint as cf
from codefootprint import DEFAULT_RULES, Rule, rules_from_table
from codefootprint.catalog import rules_df
from codefootprint.plans.profiles import profile_bits

MINIMAL = "rule_id string, name string, category string, severity int, pattern string"
CODE = {"a.py": "for i in xs:\n    for j in ys:\n        print(1)\n", "q.sql": "SELECT * FROM t;\n", "bad.py": "def f(:\n"}


def test_a_catalogue_survives_the_way_through_a_table(spark):
    assert rules_from_table(rules_df(spark)) == tuple(sorted(DEFAULT_RULES, key=lambda r: r.id))
    small = rules_from_table(spark.createDataFrame([("B", "b", "other", 1, "x"), ("A", "a", "other", 2, "y")], MINIMAL))
    assert small == (Rule("A", "a", "other", 2, pattern="y"), Rule("B", "b", "other", 1, pattern="x"))


@pytest.mark.parametrize(("rows", "problem"), [
    ([("A", "a", "other", 1, "x"), ("A", "b", "other", 1, "y")], "twice"), ([(None, "a", "other", 1, "x")], "null"),
    ([("A", "a", "other", 0, "x")], "severity"), ([("A", None, "other", 1, "x")], "name"), ([("A", "a", "other", 1, "(")], "wrong pattern"),
    ([("A", "a", "other", 1, None)], "no pattern"), ([(str(i), "a", "other", 1, "x") for i in range(4)], "more than 3"),
])
def test_unusable_tables_are_refused_before_a_scan(spark, rows, problem):
    with pytest.raises(ValueError, match=problem):
        rules_from_table(spark.createDataFrame(rows, MINIMAL), max_rules=3)


def test_only_built_in_ids_have_other_detectors(spark):
    rows = spark.createDataFrame([("GC003", "n", "compute", 4, None, "python_ast")], MINIMAL + ", detector string")
    assert rules_from_table(rows)[0].detector == "python_ast"
    with pytest.raises(ValueError, match="detector"):
        rules_from_table(rows.selectExpr("'X1' AS rule_id", "name", "category", "severity", "pattern", "detector"))


@pytest.fixture(scope="module")
def corpus(spark, files_of, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("profiled"))
    files_of([(repo, p, c) for repo in ("all", "some", "none", "unlisted", "twice") for p, c in CODE.items()]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [("all", None, 2.0), ("some", ["GC030", "GC040", "GC777"], None), ("none", [], 0.5), ("twice", ["GC001"], 1.0),
            ("twice", ["GC031", None], 3.0), (None, ["GC001"], 9.0), ("no such", None, 1.0)]
    return spark.createDataFrame(rows, "repo_id string, rule_ids array<string>, k double")


EXPECTED = {
    "all": ["GC001", "GC030", "GC031", "GC040"], "unlisted": ["GC001", "GC030", "GC031", "GC040"], "some": ["GC030", "GC040"],
    "none": [], "twice": ["GC001", "GC031"],
}


@pytest.mark.parametrize("limit", [100, 0])
def test_each_repository_has_its_own_rules(corpus, profiles, limit):
    scanned = cf.scan_profiles(corpus, profiles, broadcast_profiles=limit)
    assert scanned.columns == cf.scan_files(corpus).columns
    got = {repo: [] for repo in EXPECTED}
    for r in scanned.collect():
        got[r.repo_id] += [f.rule_id for f in r.findings]
        assert (r.error is not None) == (r.path == "bad.py")
    assert {repo: sorted(ids) for repo, ids in got.items()} == EXPECTED
    scores = {r.repo_id: (r.penalty, r.density, r.score) for r in cf.profile_scores(scanned, profiles).collect()}
    weight = {"all": 2.0, "none": 0.5, "twice": 3.0}
    severity = {r.id: r.severity for r in DEFAULT_RULES}
    for repo, (penalty, density, score) in scores.items():
        assert penalty == sum(severity[i] for i in EXPECTED[repo])
        assert score == pytest.approx(max(0, 100 - weight.get(repo, 1.0) * density), abs=0.051)


def test_no_way_moves_the_texts(corpus, profiles):
    for limit in (100, 0):
        scanned = cf.scan_profiles(corpus, profiles, broadcast_profiles=limit)
        plan = scanned._jdf.queryExecution().executedPlan().toString()
        # what lies below a shuffle must not read the texts unless the scan has turned them into findings
        tree = scanned._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        if limit:
            assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning\(repo_id[^\n]*\n[^\n]*FileScan", plan)
        else:
            join = tree.splitlines().index(next(x for x in tree.splitlines() if "Join LeftOuter" in x))
            assert not any("content#" in x for x in tree.splitlines()[: join + 1])


def test_bitmaps_of_more_than_64_rules(spark):
    rules = [Rule(f"X{i:03}", "x", "other", 1, pattern=f"word{i}") for i in range(150)]
    profiles = spark.createDataFrame([("r", ["X000", "X063", "X064", "X149"])], "repo_id string, rule_ids array<string>")
    bits = profile_bits(profiles, rules).first()[1]
    assert [n for n in range(150) if bits[n // 64] >> (n % 64) & 1] == [0, 63, 64, 149]
    text = "\n".join(f"word{i} " for i in (0, 1, 63, 64, 149))
    files = spark.createDataFrame([("r", "a.sql", len(text), text)], "repo_id string, path string, length bigint, content string")
    found = [f.rule_id for f in cf.scan_profiles(files, profiles, rules).first().findings]
    assert sorted(found) == sorted({f"X{n:03}" for n in (0, 63, 64, 149)} | {"X000"})
