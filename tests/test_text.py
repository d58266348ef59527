"""Paths, lines, whitespace, scrubbing and report values against hand-written expectations."""

import os.path
import random

from pyspark.sql import functions as F

import codefootprint as cf
from codefootprint.functions import (
    count_code_lines,
    detect_language,
    exact_round,
    extension,
    human_size,
    is_ignored_path,
    mask_code,
    split_lines,
    strip,
    strip_comments,
)

LANGUAGES = [
    ("a/b/main.py", "python"), ("Dockerfile", "dockerfile"), ("api.Dockerfile", "dockerfile"),
    ("Dockerfile.dev", "dockerfile"), ("app.tsx", "typescript"), ("styles.scss", "css"), ("notes", None),
    (".env", None), ("prod.env", "ini"), ("a.tar.gz", None), ("x/.bashrc.py", "python"), ("A.PY", "python"),
    ("p.vue", "html"), ("dockerfile/readme", None), ("x/", None), ("a.", None),
]


def test_language_and_extension(spark):
    rows = spark.createDataFrame([(p, e) for p, e in LANGUAGES], "path string, expected string")
    for row in rows.select("path", "expected", detect_language("path").alias("got"), extension("path").alias("ext")).collect():
        assert row.got == row.expected, row
        assert row.ext == os.path.splitext(row.path)[1].lower(), row


def test_ignored_folders(spark):
    cases = [
        ("a.py", False), (".gitlab-ci.yml", False), ("node_modules/x.js", True), ("a/.cache/b.py", True),
        ("src/vendor/b.go", True), ("vendor", False), ("a/Pods/b", True), ("a/pods/b", False), ("env", False),
    ]
    rows = spark.createDataFrame(cases, "path string, expected boolean")
    for row in rows.select("path", "expected", is_ignored_path("path").alias("got")).collect():
        assert row.got == row.expected, row
    custom = rows.filter(is_ignored_path("path", {"src"})).select("path").collect()
    assert sorted(r.path for r in custom) == ["a/.cache/b.py", "src/vendor/b.go"]
    # An empty set falls back to the default folders.
    assert rows.filter(is_ignored_path("path", set())).count() == 4


def test_lines_follow_all_unicode_boundaries(spark):
    texts = [
        "", "a", "a\n", "\n", "a\n\nb", "a\n\n", "\r\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x1dg\x1eh\x85i\u2028j\u2029k",
        "  \x1f \n\tx\u3000\n", "a\x1fb", "\u2003\n\u00a0a",
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "s string")
    for row in rows.select("s", split_lines("s").alias("l"), count_code_lines("s").alias("n"), strip("s").alias("t")).collect():
        assert row.l == row.s.splitlines()
        assert row.n == sum(bool(x.strip()) for x in row.s.splitlines())
        assert row.t == row.s.strip()


# language, text, text without comments, text without comments and strings
SCRUBS = [
    ("python", 'x = "select *"  # c\n', 'x = "select *"     \n', "x =                \n"),
    ("python", "'''# no\n''' # yes\n", "'''# no\n'''      \n", "       \n         \n"),
    ("python", '"""a\\""" # c', '"""a\\"""    ', " " * 12),
    ("python", '"""open # x\n', '"""open # x\n', " " * 11 + "\n"),
    ("python", "a = '#' # '\nb", "a = '#'    \nb", "a =        \nb"),
    ("python", "'a\\\n# in' # out", "'a\\\n# in'      ", "   \n           "),
    ("python", "'open\n# out", "'open\n     ", "     \n     "),
    ("python", "''\n# x", "''\n   ", "  \n   "),
    ("c", "int x; // for\n/* while\nloop */ int y;\n", "int x;       \n        \n        int y;\n",
     "int x;       \n        \n        int y;\n"),
    ("javascript", '"//" /*/ x */ y', '"//"          y', "              y"),
    # A quote ends at the line end, so the second backtick opens a new string.
    ("javascript", "`a\nb` // c", "`a\nb` // c", "  \nb      "),
    ("java", "a / b /* open", "a / b        ", "a / b        "),
    ("php", "$a = 1; # no comment", "$a = 1; # no comment", "$a = 1; # no comment"),
    ("go", "'\\'' // c", "'\\''     ", " " * 9),
    ("sql", "a - b -- c\n'--'", "a - b     \n'--'", "a - b     \n    "),
    ("sql", "/* kept */", "/* kept */", "/* kept */"),
    ("ruby", "`#x` # c", "`#x`    ", " " * 8),
    ("yaml", "a: '#' # c", "a: '#'    ", "a:        "),
    ("toml", "# kept 'x'", "# kept 'x'", "# kept    "),
    ("css", "/* kept */ \"s\"", "/* kept */ \"s\"", "/* kept */    "),
    ("html", "<!-- kept -->", "<!-- kept -->", "<!-- kept -->"),
    (None, "x # c", "x    ", "x    "),
    ("c", "\"end\\", "\"end\\", " " * 5),
    ("c", "\U0001f600 // \U0001f600\nx", "\U0001f600     \nx", "\U0001f600     \nx"),
]


def test_scrubbing(spark):
    rows = spark.createDataFrame([(i, lang, text) for i, (lang, text, _, _) in enumerate(SCRUBS)],
                                 "i int, language string, s string")
    got = rows.select("i", "s", strip_comments("s", "language").alias("a"), mask_code("s", "language").alias("b"))
    for row in got.collect():
        _, text, stripped, masked = SCRUBS[row.i]
        assert row.a == stripped, (SCRUBS[row.i], row.a)
        assert row.b == masked, (SCRUBS[row.i], row.b)
        assert len(row.a) == len(row.b) == len(text)


def test_scrubbing_does_not_overflow_on_long_literals(spark):
    size = 1_500_000
    rows = spark.createDataFrame([("c", '"' + "x" * size + '" // c'), ("python", "'''" + "\n" * size + "'''#")],
                                 "language string, s string")
    lengths = rows.select(F.length(mask_code("s", "language"))).collect()
    assert [r[0] for r in lengths] == [size + 7, size + 7]


def test_decoding(files_of):
    files = files_of({
        "a.py": b"x\r\ny\rz\n", "b.py": b"\xff\xfe", "c.py": "\ufeffx = 1\n", "d.py": b"", "e.py": "é\n",
    })
    got = {r.path: r.t for r in files.select("path", cf.decode_text("content").alias("t")).collect()}
    assert got == {"a.py": "x\ny\nz\n", "b.py": None, "c.py": "\ufeffx = 1\n", "d.py": "", "e.py": "é\n"}


def test_rounding_follows_the_exact_binary_value(spark):
    random.seed(3)
    numbers = [0.25, 0.75, 92.45, 0.05, 0.15, 99.95, 100.0, 0.0, 2.675, 1.005, 1e6 + 0.05]
    numbers += [random.choice((random.random() * 100, random.randint(0, 2000) / 20, random.randint(0, 20000) / 200))
                for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in numbers], "v double")
    for row in rows.select("v", exact_round(F.col("v"), 1).alias("a"), exact_round(F.col("v"), 2).alias("b")).collect():
        assert (row.a, row.b) == (round(row.v, 1), round(row.v, 2))


def test_sizes(spark):
    cases = [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"), (512000, "500.0 KB"),
             (2**20, "1.0 MB"), (2**30 - 1, "1024.0 MB"), (5 * 2**40, "5120.0 GB")]
    rows = spark.createDataFrame(cases, "n bigint, expected string")
    for row in rows.select("expected", human_size("n").alias("got")).collect():
        assert row.got == row.expected
