"""Scores, rankings, reports, admission and streams on small tables."""

import json

import pytest
from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.catalog import DEFAULT_RULES, FIX_GUIDES

FOUND = (
    "repo_id string, rule_id string, path string, line int, column int, snippet string, message string, "
    "extra map<string,string>"
)
STATS = "repo_id string, path string, language string, code_lines int, bytes bigint"


def findings(spark, rows):
    full = [(repo, rule, path, line, 0, f"line {line}", "m", {}) for repo, rule, path, line in rows]
    return spark.createDataFrame(full, FOUND)


def stats(spark, rows):
    return spark.createDataFrame([(repo, f"{repo}.x", language, lines, 1) for repo, language, lines in rows], STATS)


def test_scores(spark):
    files = stats(spark, [("none", "python", 500), ("some", "python", 1000), ("all", "go", 10), ("yaml", "yaml", 9000),
                          ("tiny", None, 5)])
    found = findings(spark, [("some", "GC001", "a.py", i) for i in range(10)]
                     + [("all", "GC062", "a.go", i) for i in range(50)] + [("yaml", "GC091", "a.yml", 1)]
                     + [("some", "OTHER", "a.py", 1)])
    got = {r.repo_id: r for r in cf.repo_scores(files, found).collect()}
    assert (got["none"].score, got["none"].grade, got["none"].penalty) == (100.0, "A", 0)
    some = got["some"]
    assert (some.penalty, some.density, some.score, some.grade, some.total_violations) == (30, 30.0, 70.0, "C", 11)
    assert (got["all"].score, got["all"].grade) == (0.0, "G")
    # No code lines: the floor of 0.1 thousand lines applies.
    assert (got["yaml"].total_code_lines, got["yaml"].density, got["yaml"].score) == (0, 10.0, 90.0)
    assert got["tiny"].score == 100.0
    doubled = {r.repo_id: r.score for r in cf.repo_scores(files, found, k=2.0).collect()}
    assert doubled["some"] == 40.0
    assert sorted(r.repo_id for r in cf.quality_gate(cf.repo_scores(files, found), 70.0).collect()) == ["all"]


def test_grades(spark):
    cases = [(95.0, "A"), (90.0, "A"), (89.9, "B"), (85.0, "B"), (75.0, "C"), (65.0, "D"), (50.0, "E"), (30.0, "F"),
             (10.0, "G"), (-1.0, "G")]
    rows = spark.createDataFrame(cases, "score double, expected string")
    assert all(r.grade == r.expected for r in cf.grade_scores(rows).collect())


def test_category_and_rule_ranks(spark):
    found = findings(spark, [("r", "GC020", "a", 1), ("r", "GC001", "a", 1), ("r", "GC040", "a", 1), ("r", "GC050", "a", 1),
                             ("r", "GC041", "a", 1), ("r", "NONE", "a", 1)])
    categories = sorted(cf.category_scores(found).collect(), key=lambda r: r.rank)
    assert [(c.category, c.penalty) for c in categories] == [
        ("network", 4), ("compute", 3), ("observability", 2), ("dependencies", 1)]
    assert sum(c.percent_of_penalty for c in categories) == pytest.approx(100)
    rules = sorted(cf.rule_scores(found).collect(), key=lambda r: r.rank)
    assert [r.rule_id for r in rules] == ["GC020", "GC001", "GC040", "GC041", "GC050"]


def test_top_lists_keep_order_and_count_the_rest(spark):
    found = findings(spark, [("r", "GC040", f"f{i:03}", 1) for i in range(40)] + [("r", "GC062", "z", 9), ("r", "NONE", "a", 0)])
    top = sorted(cf.top_violations(found).collect(), key=lambda r: r["rank"])
    assert len(top) == 15 and (top[0].rule_id, top[0].location) == ("GC062", "z:9")
    assert [t.location for t in top[1:]] == [f"f{i:03}:1" for i in range(14)]
    per_rule = cf.top_per_rule(found).filter("rule_id = 'GC040'").collect()
    assert len(per_rule) == 25 and {(r["count"], r.others) for r in per_rule} == {(40, 15)}
    ordered = [r.severity for r in cf.sorted_violations(found).collect()]
    assert len(ordered) == 41 and ordered == sorted(ordered, reverse=True)


def test_labels_and_guides(spark):
    found = findings(spark, [("r", "GC062", "a", 1), ("r", "NONE", "a", 1)])
    labels = {r.rule_id: (r.severity_label, r.category_label) for r in cf.label_violations(found).collect()}
    assert labels == {"GC062": ("critica", "Energia & Runtime"), "NONE": (None, None)}
    fixed = cf.violations_with_fix(found).collect()
    assert [(r.rule_id, r.has_example) for r in fixed] == [("GC062", True)]
    assert [(r.problem, r.rule_id) for r in cf.catalog_integrity(found).collect()] == [("no rule", "NONE"), ("no guide", "NONE")]


def test_every_rule_has_a_complete_guide():
    assert {r.id for r in DEFAULT_RULES} == set(FIX_GUIDES)
    assert all(g.steps and g.bad and g.good for g in FIX_GUIDES.values())
    assert len(DEFAULT_RULES) == 44 and all(r.description and r.remediation for r in DEFAULT_RULES)


def test_report_documents_and_files(spark, tmp_path):
    files = stats(spark, [("r", "python", 100), ("r", "go", 50), ("clean", "go", 1)])
    found = findings(spark, [("r", "GC001", "a", 1), ("r", "GC040", "a", 2), ("r", "NONE", "a", 3)])
    errors = spark.createDataFrame([("r", "b.py", "bad")], "repo_id string, path string, message string")
    cf.write_report(files, found, errors, str(tmp_path / "report"))
    documents = {r.repo_id: json.loads(r.document) for r in cf.read_committed(spark, str(tmp_path / "report"), "repositories", fmt="json").collect()}
    index = documents["r"]["index"]
    assert (index["score"], index["grade"], index["penalty"], index["total_violations"]) == (73.3, "C", 4, 3)
    assert [c["category"] for c in index["categories"]] == ["compute", "observability"]
    assert [c["percent_of_penalty"] for c in index["categories"]] == [75.0, 25.0]
    assert documents["r"]["stats"]["language_breakdown"] == {"python": 100, "go": 50}
    assert documents["clean"]["index"]["categories"] == [] and documents["clean"]["index"]["score"] == 100.0
    lines = [json.loads(r.finding) for r in cf.read_committed(spark, str(tmp_path / "report"), "findings", fmt="json").collect()]
    unknown = next(x for x in lines if x["rule_id"] == "NONE")
    assert len(lines) == 3 and unknown["rule_name"] == "NONE" and unknown["category"] is None and unknown["severity"] is None
    assert cf.read_committed(spark, str(tmp_path / "report"), "report_errors", fmt="json").count() == 1


SAMPLE = {
    "job.py": (
        '"""Teaching example."""\n\nimport time\n\nimport requests\n\n\ndef pair(left, right):\n    # nested\n    out = []\n'
        "    for a in left:\n        for b in right:\n            out.append((a, b))\n    text = ''\n    for o in out:\n"
        "        text += str(o) + ';'\n    for a in left:\n        requests.get(a)\n    return text\n\n\n"
        "def load(path):\n    fh = open(path)\n    return fh.read()\n\n\ndef enrich(rows, db):\n    for r in rows:\n"
        "        db.query('SELECT * FROM d WHERE id = 1')\n\n\ndef work():\n    while True:\n        step()\n"
        "        time.sleep(1)\n\n\ndef step():\n    print('step')  # debug\n"
    ),
    "settings.py": "# debug on\nDEBUG = True\n",
    "style.css": ".a {\n  animation: b 1s infinite;\n}\n",
    "ui.js": "for (let i = 0; i < n; i++) {\n  for (let j = 0; j < n; j++) {\n  }\n}\nsetInterval(() => f(), 16);\n",
    "q.sql": "SELECT * FROM a WHERE b = 1;\nSELECT id FROM c;\n",
    "Dockerfile": "FROM python:latest\nRUN pip install -r requirements.txt\n",
    "compose.yml": "restart: always\nreplicas: 8\n",
    "requirements.txt": "requests>=2.0\ntensorflow>=2.10\n",
}


def test_sample_project_end_to_end(files_of):
    scanned = cf.scan_files(files_of(SAMPLE))
    found = sorted((r.path, r.rule_id, r.line) for r in cf.violations(scanned).collect())
    assert found == sorted([
        ("job.py", "GC001", 12), ("job.py", "GC002", 16), ("job.py", "GC020", 18), ("job.py", "GC022", 18),
        ("job.py", "GC011", 23), ("job.py", "GC010", 24), ("job.py", "GC021", 29), ("job.py", "GC030", 29),
        ("job.py", "GC003", 33), ("job.py", "GC040", 39), ("settings.py", "GC060", 2), ("style.css", "GC061", 2),
        ("ui.js", "GC001", 2), ("ui.js", "GC063", 5), ("q.sql", "GC030", 1), ("q.sql", "GC031", 2),
        ("Dockerfile", "GC080", 1), ("Dockerfile", "GC081", 1), ("Dockerfile", "GC083", 1), ("Dockerfile", "GC082", 2),
        ("compose.yml", "GC091", 1), ("compose.yml", "GC093", 2), ("requirements.txt", "GC051", 2),
    ])
    score = cf.scan_scores(scanned).collect()[0]
    severity = {r.id: r.severity for r in DEFAULT_RULES}
    assert score.penalty == sum(severity[rule] for _, rule, _ in found)
    assert (score.total_files, score.code_files, score.score, score.grade) == (8, 6, 0.0, "G")
    tables = cf.repo_scores(cf.file_stats(scanned), cf.violations(scanned)).collect()[0]
    assert tables.asDict() == {k: score[k] for k in tables.asDict()}


def test_targets(spark):
    cases = [
        ("https://github.com/some/Repo", ("some", "Repo")), ("https://github.com/u/r.git", ("u", "r")),
        ("github.com/u/r/tree/main", ("u", "r")), ("some/Repo", ("some", "Repo")), (" u/r.git ", ("u", "r")),
        ("https://GitHub.com:443/u/r?x=1#y", ("u", "r")), ("https://a@www.github.com//u//r;p", ("u", "r")),
        ("https://gitlab.com/u/r", None), ("https://evil.example.com/u/r", None), ("not a repo", None), ("", None),
        (None, None), ("http://127.0.0.1/u/r", None), ("http://localhost:8000/a/b", None), ("github.com/u", ("github.com", "u")),
        ("u/.git", None), ("u /r", None), ("ht tp://github.com/u/r", None), ("git@github.com:u/r.git", None),
        ("https://github.com@evil.com/u/r", None), ("u/r/", None), ("https://github.com/u/r%20", None),
    ]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "target string")
    got = {r.target: (r.owner, r.repo) for r in cf.normalize_targets(rows).collect()}
    for target, expected in cases:
        assert got[target] == (expected or (None, None)), target


def test_admission(spark):
    files = spark.createDataFrame(
        [("ok", "a", 5), ("ok", "../b", 10**12), ("ok", "/c", 10**12), ("big", "a", 200 * 1024 * 1024 + 1), ("edge", "a..b", 200 * 1024 * 1024)],
        "repo_id string, path string, length bigint")
    got = {r.repo_id: (r.files, r.admitted, r.reason) for r in cf.admit_repos(files, max_bytes=200 * 1024 * 1024).collect()}
    assert got == {"ok": (1, True, None), "big": (1, False, "too large"), "edge": (1, True, None)}
    assert cf.admit_repos(files).filter("admitted").count() == 3
    many = cf.admit_repos(files, max_files=0).filter("not admitted").count()
    assert many == 3
    snippets = spark.createDataFrame(
        [("a", " \n", "sql"), ("b", "x" * 200_000, "sql"), ("c", "é" * 100_001, "sql"), ("d", "x", "cobol"), ("e", "x", None)],
        "name string, source string, language string")
    def reasons(**limits):
        return {r.name: (r.language, r.admitted, r.reason) for r in cf.admit_snippets(snippets, **limits).collect()}

    limited = reasons(max_bytes=200_000)
    assert limited == {
        "a": ("sql", False, "blank"), "b": ("sql", True, None), "c": ("sql", False, "too large"),
        "d": ("python", True, None), "e": ("python", True, None),
    }
    assert reasons() == {**limited, "c": ("sql", True, None)}
    requested = spark.createDataFrame([("ok",), ("gone",)], "repo_id string")
    assert [r.repo_id for r in cf.missing_repo_errors(requested, files).collect()] == ["gone"]


def test_usage_totals(spark):
    rows = spark.createDataFrame([("repository", 2.0), ("repository", 3.5), ("repository", -9.0), ("snippet", 7.0)],
                                 "kind string, kwh double")
    assert tuple(cf.usage_totals(rows).collect()[0]) == (3, 5.5)
    assert tuple(cf.usage_totals(rows.filter(F.lit(False))).collect()[0]) == (0, 0.0)


def test_streams_continue_where_they_stopped(spark, tmp_path, files_of):
    incoming, output = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "repo_id string, path string, length bigint, content binary"

    def arrive(name):
        files_of({name: "for a in b:\n    for c in d:\n        print(1)\n"}).coalesce(1).write.mode("append").parquet(incoming)

    def run():
        stream = spark.readStream.schema(schema).parquet(incoming)
        cf.start_scan(stream, output, str(tmp_path / "ck")).awaitTermination()
        return sorted((r.path, r.rule_id) for r in cf.violations(spark.read.parquet(output)).collect())

    arrive("a.py")
    assert run() == [("a.py", "GC001"), ("a.py", "GC040")]
    arrive("b.py")
    assert run() == [("a.py", "GC001"), ("a.py", "GC040"), ("b.py", "GC001"), ("b.py", "GC040")]


def test_a_repository_without_files_scores_full_marks(spark, files_of):
    requested = spark.createDataFrame([("r",), ("missing",)], "repo_id string")
    scores = cf.scan_scores(cf.scan_files(files_of({"a.py": "print(1)\n"})), requested=requested)
    assert {r.repo_id: (r.score, r.grade, r.total_files) for r in scores.collect()} == {
        "r": (90.0, "A", 1), "missing": (100.0, "A", 0)}
