"""Custom patterns find the same lines and columns as in their own dialect."""

import re

import pytest
from pyspark.sql import functions as F

from codefootprint.functions.sqltext import quote
from codefootprint.functions.text import code_point_column_sql, java_regex

LINES = [
    "", "__ aabbz", "x = 'it' + \"that\"", "a\\sb a b", "a\x1fb  c", "if (x[3] && y) { return {1,2}; }", "Key: value, key: VALUE",
    "2024-05-06 and 2024-05-07", "héllo wörld 𝒳 end", "aaa{,3} b{2 c}d", "]^[-&", "foo.bar(baz)", "tab\there", "ÀÉ àé ß", "one two two three",
    "abcabcabc", "10 1010 100", "trailing space ", "<a href='x'>", "😀 smile",
]
PATTERNS = [
    r"(\w)\1z", r"a\\sb", r"(?P<q>['\"])\w+(?P=q)", r"(?P<first_word>\w+) (?P=first_word)", r"\s", r"\S+$", r"[\s]b", r"[^\s]b", r"[a\s]+b",
    r"\[\d\]", r"[[]\d[]]", r"[]^]", r"[^]]x", r"&&", r"[&]{2}", r"[a&&b]", r"\bkey\b", r"(?i)KEY", r"\d{4}-\d{2}-\d{2}$", r"^x", r"end\Z", r"wörld",
    r"\w+ö\w", r"a{,2}b", r"a{2,}", r"\{", r"{ return", r"c}", r"b{2 c", r"(abc)\1\1", r"(a)(b)(c)\1\2\3", r"(10) \1", r"(1)(0) \1\2\1",
    r"\x1f", r"é", r"\U0001F600", r"[\t]", r"(?<=two )three", r"foo\.(?!baz)\w+\(", r"(?:one|two) (two|three)", r"[\w.]+\(", r".\s$", r"é|É",
]


def test_patterns_match_as_in_their_dialect(spark):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")
    for ignore_case in (False, True):
        columns = [
            F.expr(f"IF(line RLIKE {quote(java_regex(p, ignore_case))}, {code_point_column_sql('line', p, ignore_case)}, 0)").alias(f"p{k}")
            for k, p in enumerate(PATTERNS)
        ]
        found = rows.select("i", *columns).orderBy("i").collect()
        for k, pattern in enumerate(PATTERNS):
            seen = [re.search(pattern, line, re.I if ignore_case else 0) for line in LINES]
            assert [r[f"p{k}"] for r in found] == [m.start() + 1 if m else 0 for m in seen], pattern


@pytest.mark.parametrize("pattern", ["(", "[a", r"(a)(?(1)b|c)", "*a"])
def test_wrong_patterns_are_refused_before_any_job(pattern):
    with pytest.raises(ValueError):
        java_regex(pattern)
