"""Rules on long lines: linear forms find what the plain patterns find, and lines and texts of any size are scanned."""

import random
import time
from dataclasses import replace

import pytest

import codefootprint as cf
from codefootprint.catalog import select_rules

WORDS = {
    "GC031": ("select", " ", "  ", "a", "*", "from", "selects", ";", "'", "t", "FROM", "where"),
    "GC032": ("update", "delete", "from", " ", " ", "t", "set", "where", "limit", ";", "wherever", "SET", "=", "_"),
    "GC061": ("animation", "-iteration-count", ":", " ", ";", "infinite", "infinitely", "x", "-"),
    "GC092": ("cache", "-", "control", "_", " ", "no-store", ":", "cachecontrol", "x"),
}
LANGUAGE = {"GC031": "sql", "GC032": "sql", "GC061": "css", "GC092": "python"}
LONG = {
    "GC031": "select a from b, ", "GC032": "update t set a where ", "GC061": "animation: ", "GC092": "cache-control ",
}


def found(spark, rule, lines):
    rows = spark.createDataFrame([("r", "f", "\n".join(lines), LANGUAGE[rule.id])],
                                 "repo_id string, name string, source string, language string")
    hits = cf.violations(cf.scan_sources(rows, (rule,))).collect()
    return sorted((h.line, h.column, h.snippet) for h in hits)


@pytest.mark.parametrize("rule_id", WORDS)
def test_linear_forms_find_the_same(spark, rule_id):
    rule, = select_rules((rule_id,))
    rng = random.Random(7)
    lines = ["x" + "".join(rng.choices(WORDS[rule_id], k=rng.randint(2, 16))) for _ in range(4000)]
    lines += [" ".join(rng.choices(WORDS[rule_id], k=rng.randint(2, 14))) for _ in range(4000)]
    plain = found(spark, replace(rule, linear=None), lines)
    assert len(plain) > 20
    assert found(spark, rule, lines) == plain


@pytest.mark.parametrize("rule_id", LONG)
def test_a_line_of_a_megabyte(spark, rule_id):
    rule, = select_rules((rule_id,))
    unit = LONG[rule_id]
    start = time.time()
    hits = found(spark, replace(rule, hints=()), [unit * (1_000_000 // len(unit))])
    assert hits == [] and time.time() - start < 20


def test_status_and_whole_lines(spark):
    long = "print(" + "a" * 500 + ")"
    files = spark.createDataFrame([
        ("r", "a.py", 10, bytearray(long.encode())), ("r", "b.py", 10, bytearray(b"\xff\xfe")), ("r", "c.png", 10, None),
        ("r", "d.unknown", 10, bytearray(b"x")), ("r", "e.py", 99, bytearray(b"x = 1")), ("r", "f.py", 1, None),
    ], "repo_id string, path string, length bigint, content binary")
    scanned = cf.scan_files(files, select_rules(("GC040",)), max_text_bytes=50)
    assert {r.path: r.status for r in scanned.select("path", "status").collect()} == {
        "a.py": "scanned", "b.py": "not UTF-8", "c.png": "asset", "d.unknown": "unknown language",
        "e.py": "over the limit", "f.py": "no content",
    }
    assert [v.snippet for v in cf.violations(scanned).collect()] == [long]
