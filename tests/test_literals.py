"""One dictionary search for all line patterns: same findings as each pattern on its own, at any number of rules."""

import random
import re
import time

import pytest

import codefootprint as cf
from codefootprint import DEFAULT_RULES, Rule
from codefootprint.functions.literals import any_literal, first_characters, required_literals
from codefootprint.operators.regex_rules import literals_of, regex_rules

PATTERNS = (
    r"\bfor\s+\w+\s+in\b", r"(a|bc)d+x*", r"\*", r"(?:foo|ba[rz]+q)+", r"x?|y", r"(?i)Ab(?=zzzz)", r"[a-z]+", r"a(?:b|)c{2,}",
    r"(?P<q>['\"]).*(?P=q)", r"[^x]yes", r"(?>ab|c)d", r"q{0,3}w",
)


def test_required_literals_stand_in_every_match():
    rng = random.Random(7)
    texts = ["".join(rng.choices("abcdfoxyzqr*w ni'\"", k=rng.randint(0, 14))) for _ in range(4000)]
    texts += ["for x in y", "foofoo", "barq bazzq", "abcc", "accc", "'a'", "YES", "ayes", "cd", "qqw"]
    for pattern in PATTERNS:
        words = required_literals(pattern)
        for text in texts:
            for match in re.finditer(pattern, text):
                assert not words or any(w in match[0].lower() for w in words), (pattern, text)
    assert required_literals(r"\bfor\s+\w+\s+in\b") == ("for",) and required_literals(r"[a-z]+") == ()


def test_prefix_tree_finds_the_longest_word_at_its_place():
    rng = random.Random(3)
    words = {"".join(rng.choices("ab.*[]-^\\", k=rng.randint(1, 4))) for _ in range(60)} | {"log", "logger", "select"}
    for shape in (any_literal(words), f"(?={first_characters(words)})(?:{any_literal(words)})"):
        pattern = re.compile(shape)
        for _ in range(3000):
            text = "".join(rng.choices("ab.*[]-^\\logers", k=8))
            fits = [w for w in words if text.startswith(w)]
            match = pattern.match(text)
            assert (match[0] if match else None) == (max(fits, key=len) if fits else None)


def test_every_line_rule_of_the_catalogue_is_in_the_dictionary():
    assert all(literals_of(rule) for rule in regex_rules(DEFAULT_RULES))
    assert literals_of(Rule("X", "x", "other", 1, pattern=r"(?i)kiss")) == ()


def plain(rules, text):
    """Each pattern searched on its own."""
    found = []
    for rule in rules:
        for i, line in enumerate(text.split("\n"), 1):
            if re.search(rule.pattern, line, re.I if rule.ignore_case else 0):
                found.append((rule.id, i))
    return sorted(found)


def test_findings_equal_single_searches(found_in):
    rules = [
        Rule("A", "a", "other", 1, pattern="log"), Rule("B", "b", "other", 1, pattern=r"logger\.debug"),
        Rule("C", "c", "other", 1, pattern=r"GER", ignore_case=True), Rule("D", "d", "other", 1, pattern=r"\d{3}"),
        Rule("E", "e", "other", 1, pattern="Straße", ignore_case=True), Rule("F", "f", "other", 1, pattern="k", ignore_case=True),
        Rule("G", "g", "other", 1, pattern="(?i)kelvin"), Rule("H", "h", "other", 1, pattern=r"bcd"), Rule("I", "i", "other", 1, pattern=r"abc"),
    ]
    texts = ["logger.debug\nblogger\nabcd 123\nGER ger\n", "straße STRASSE\nK Kelvin kelvin\nlog\n", "nothing\n", "ab\ncd\n"]
    for text in texts:
        got = sorted((rule, line) for _, rule, line in found_in({"a.sql": text}, rules=rules))
        assert got == plain(rules, text.rstrip("\n")), text


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("many"))
    line = "concat('x = compute(a', id, '); total += y', id % 7, '; # note')"
    text = f"concat_ws('\\n', transform(sequence(1, 40), i -> {line}), concat('call_', id % 400, '()'))"
    spark.range(6000).selectExpr("'r' AS repo_id", "concat('f', id, '.sql') AS path", f"{text} AS content").selectExpr(
        "repo_id", "path", "CAST(octet_length(content) AS BIGINT) AS length", "content"
    ).write.mode("overwrite").parquet(path)
    return cf.read_corpus(spark, path)


def test_hundreds_of_rules_cost_little_more_than_the_catalogue(many):
    custom = [Rule(f"X{i:03}", "x", "other", 1, pattern=rf"\bcall_{i}\(") for i in range(300)]

    def seconds(rules):
        found = cf.violations(cf.scan_files(many, rules)).groupBy("rule_id").count()
        found.write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        found.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    few = seconds(regex_rules(DEFAULT_RULES))
    assert seconds(custom) <= 3 * few + 2
    assert cf.violations(cf.scan_files(many, custom)).count() == 300 * 15


def test_one_search_of_a_text_serves_all_rules(many):
    plan = cf.scan_files(many, regex_rules(DEFAULT_RULES)).select("findings")._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RLIKE\(_lower|_lower#\d+ RLIKE", plan)) == 1 and "Contains(_lower" not in plan
