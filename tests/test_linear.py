"""Work inside one file grows with its size: many loops, functions and dependencies, against plain searches."""

import json
import random
import re
import time

import pytest

import codefootprint as cf
from codefootprint.catalog import select_rules
from codefootprint.operators.manifest_rules import package_entries
from codefootprint.operators.pyfacts import KINDS, facts_type, node_rows

MANY = 50_000


def seconds(df):
    df.write.format("noop").mode("overwrite").save()  # compile and warm
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


@pytest.mark.parametrize(("rule", "unit"), [
    ("GC003", "while True:\n    time.sleep(1)\n"),
    ("GC009", "def f(n):\n    return f(n - 1) + f(n - 2)\n"),
    ("GC040", "print(1)\nx = 1\n"),
])
def test_many_findings_in_one_file(files_of, rule, unit):
    found = cf.violations(cf.scan_files(files_of({"a.py": unit * MANY}), select_rules((rule,))))
    assert seconds(found) < 10 and found.count() == MANY


def test_counts_below_a_node_against_the_tree(spark, files_of):
    rng = random.Random(5)

    def block(depth):
        pad, out = "    " * depth, []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["while True", "while x", "def f()", "def g()", "async def f()", "call", "call", "call"])
            if kind == "call" or depth > 5:
                out.append(pad + rng.choice(["time.sleep(1)", "sleep(1)", "f()", "g(f())", "o.f()", "x = 1"]))
            else:
                out += [f"{pad}{kind}:", *block(depth + 1)]
        return out

    for _ in range(60):
        rows = node_rows("\n".join(block(0)))
        for row in rows:
            below = [r for r in rows if row["pre"] < r["pre"] <= row["post"] and r["kind"] == "Call"]
            if row["kind"] == "While":
                assert row["sleeps_below"] == sum(r["call_attr"] == "sleep" and not r["func_is_name"] for r in below)
            if row["kind"].endswith("FunctionDef"):
                assert row["self_calls"] == sum(r["func_is_name"] and r["call_attr"] == row["name"] for r in below)


def test_only_what_rules_read_leaves_the_parser(spark, files_of):
    files = files_of({"a.py": "import time\nwhile True:\n    time.sleep(1)\ndef f():\n    f()\n"})
    plan = cf.scan_files(files, select_rules(("GC003",))).select("findings")._jdf.queryExecution().optimizedPlan().toString()
    assert "sleeps_below" in plan and "decorators" not in plan and "call_root" not in plan
    nodes = cf.python_nodes(files, kinds=("While",), fields=("kind", "line", "post"))
    assert nodes.columns == ["repo_id", "path", "post", "kind", "line"] and [tuple(r)[2:] for r in nodes.collect()] == [(2, "While", 2)]
    assert cf.python_nodes(files).count() == 4 and "sleeps_below" in facts_type()
    with pytest.raises(ValueError):
        cf.python_nodes(files, kinds=(*KINDS, "Name"))


SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def expected(text):
    """Entries with their line: last of a repeated key, first line that begins with the quoted key and a colon."""
    parsed = json.loads(text)
    lines = [line.strip() for line in text.split("\n")]
    out = []
    for section in SECTIONS:
        for key in parsed.get(section, {}):
            line = next((i for i, s in enumerate(lines, 1) if re.match(re.escape(f'"{key}"') + r"\s*:", s)), 0)
            out.append((section, key, line))
    return sorted(out)


def test_dependency_lines_against_a_plain_search(spark, files_of):
    rng = random.Random(2)
    texts = []
    for _ in range(120):
        names = [rng.choice(["a", "b", "c", "lodash", "x-y", "ä", 'q\\"r', "dependencies"]) for _ in range(8)]
        parts = []
        for section in rng.sample(SECTIONS, rng.randint(1, 4)):
            sep = rng.choice([",\n  ", ", ", ",\n\n"])
            body = sep.join(f'"{n}"{rng.choice(["", " "])}: "{rng.choice(["1", "*"])}"' for n in rng.choices(names, k=rng.randint(0, 6)))
            parts.append(f'"{section}": {{{rng.choice(["", chr(10)])}{body}}}')
        texts.append("{" + ",\n".join(parts) + "}")
    files = files_of([(str(i), "package.json", text) for i, text in enumerate(texts)])
    got = {}
    for r in package_entries(files).collect():
        got.setdefault(int(r.repo_id), []).append((r.section, r.key, r.line))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == expected(text), text


def test_a_manifest_of_many_dependencies(spark, files_of):
    def manifest(n):
        body = ",\n".join(f'"pkg{i % (n - n // 10)}": "1.{i}"' for i in range(n))  # a tenth of the keys comes twice
        return f'{{"dependencies": {{\n{body}\n}}}}'

    large = package_entries(files_of({"package.json": manifest(200_000)}))
    assert seconds(large) < 20
    rows = {r.name: (r.line, r.version) for r in large.filter("name IN ('pkg7', 'pkg150000')").collect()}
    assert rows == {"pkg7": (9, "1.180007"), "pkg150000": (150_002, "1.150000")} and large.count() == 180_000
