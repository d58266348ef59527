"""Detectors on small files: flagged and not flagged, with places."""

import pytest

import codefootprint as cf
from codefootprint.catalog import Rule, select_rules
from workloads.templates import TEMPLATES

# file name, text, rules that must be there, rules that must not
PAIRS = [
    ("a.py", "page = 'a'\nwhile rows:\n    page += '<li>' + rows.pop()\n", {"GC002"}, set()),
    ("a.py", "for i in x:\n    s += i\n", set(), {"GC002"}),
    ("a.py", "while 1:\n    time.sleep(1)\n", set(), {"GC003"}),
    ("a.py", "while True:\n    def f():\n        clock.sleep(1)\n", {"GC003"}, set()),
    ("a.py", "while True:\n    sleep(1)\n", set(), {"GC003"}),
    ("a.py", "re.search('a', x)\n", set(), {"GC004"}),
    ("a.py", "for x in y:\n    def f():\n        re.search('a', x)\n", {"GC004"}, set()),
    ("a.py", "import time\nasync def f():\n    time.sleep(1)\n", {"GC005"}, set()),
    ("a.py", "def f():\n    time.sleep(1)\n", set(), {"GC005"}),
    ("a.py", "async def f():\n    g(lambda: time.sleep(1))\n", {"GC005"}, set()),
    ("a.py", "def g():\n    async def f():\n        class C:\n            time.sleep(1)\n", {"GC005"}, set()),
    ("a.py", "while todo:\n    best = sorted(todo, key=cost)[0]\n", {"GC007"}, set()),
    ("a.py", "for x in y:\n    sort()\n", {"GC007"}, set()),
    ("a.py", "[sorted(x) for x in y]\n", set(), {"GC007"}),
    ("a.py", "while q in (1, 2):\n    pass\n", {"GC008"}, set()),
    ("a.py", "for x in y:\n    x in {1, 2}\n", set(), {"GC008"}),
    ("a.py", "for x in y:\n    a < b not in [1]\n", {"GC008"}, set()),
    ("a.py", "def walk(node):\n    walk(node.next)\n", set(), {"GC009"}),
    ("a.py", "@cache()\ndef f(n):\n    return f(n - 1) + f(n - 2)\n", set(), {"GC009"}),
    ("a.py", "class A:\n    def f(self):\n        self.f()\n        self.f()\n", set(), {"GC009"}),
    ("a.py", "def f(n):\n    def g():\n        f(1)\n        f(2)\n", {"GC009"}, set()),
    ("a.py", "with open(name, 'rb') as source:\n    parse(source.read())\n", {"GC010"}, {"GC011"}),
    ("a.py", "with closing(open('x')) as f:\n    pass\n", {"GC011"}, set()),
    ("a.py", "async with open('x') as f:\n    pass\n", set(), set()),
    ("a.py", "x.open('y')\n", set(), {"GC011"}),
    ("a.py", "chars = sum(len(word) for word in words)\n", set(), {"GC012"}),
    ("a.py", "x.sum([i for i in d])\n", set(), {"GC012"}),
    ("a.py", "x.join([i for i in d])\njoin([i for i in d])\n", {"GC012"}, set()),
    ("a.py", "for x in y:\n    deepcopy(x)\n", {"GC013"}, set()),
    ("a.py", "for x in y:\n    urllib.request.urlopen(x)\n", {"GC020"}, {"GC021"}),
    ("a.py", "for x in y:\n    session.get(x)\n", {"GC021"}, {"GC020"}),
    ("a.py", "for x in y:\n    requests.get(x, timeout=1)\n", {"GC020"}, {"GC022"}),
    ("a.py", "for x in y:\n    conn.execute(q)\n    get(x)\n", set(), {"GC021"}),
    ("a.py", "for x in y:\n    c().execute(q)\n", {"GC021"}, set()),
    ("a.py", "for x in y:\n    User.objects.filter(a=x)\n", {"GC021"}, set()),
    ("a.py", "blocklist = ['coinhive', 'cryptonight']\n", set(), {"GC062"}),
    ("a.py", "HEADERS = {'cache-control': 'private, no-store'}\n", {"GC092"}, set()),
    ("a.py", "HEADERS = {'cache-control': 'public, immutable'}\n", set(), {"GC092"}),
    ("a.py", "logging.debug('x=%s', x)\n", {"GC041"}, {"GC042"}),
    ("a.js", "fetch('/api');\n", {"GC023"}, set()),
    ("a.js", "fetch('/api', { signal: c.signal });\n", set(), {"GC023"}),
    ("a.js", "setInterval(() => f(), 100);\n", set(), {"GC063"}),
    ("a.js", "do { a(); } while (x);\nfor (;;) { }\n", set(), {"GC001"}),
    ("a.c", "while (a) { b(); while (c) { d(); } }", {"GC001"}, set()),
    ("a.c", "for(;;) for(;;) x();\n", set(), {"GC001"}),
    ("a.c", "// for {\nfor (;;) { \"for {\"; }\n", set(), {"GC001"}),
    ("a.php", "foreach ($a as $b) { if (1) { while (2) { } } }", {"GC001"}, set()),
    ("q.sql", "select id from parts where label like 'M8-%' limit 3;\n", set(), {"GC033", "GC031"}),
    ("q.sql", "update t set a = 1 where b = 2;\ndelete from t limit 5;\n", set(), {"GC032"}),
    ("q.sql", "delete from t; -- where\n", {"GC032"}, set()),
    ("p.html", "<IMG SRC=a LOADING = lazy>\n", set(), {"GC071"}),
    ("p.html", "<img src=a><img loading=lazy>\n", {"GC071"}, set()),
    ("p.vue", "<audio autoplay>\n", {"GC064"}, set()),
    ("c.yml", 'cron: "0 */6 * * *"\n', set(), {"GC090"}),
    ("c.yml", "restart: on-failure\nreplicas: 3\n", set(), {"GC091", "GC093"}),
    ("c.yaml", "restartPolicy: Always\nreplicas: 12\n", {"GC091", "GC093"}, set()),
    ("README.md", "SELECT * FROM t;\n", set(), {"GC030", "GC031"}),
    ("Dockerfile", "FROM maven:3.9\nWORKDIR /build\n", {"GC083", "GC081"}, {"GC080", "GC082"}),
    ("Dockerfile", "from scratch\n", {"GC080"}, {"GC081", "GC083"}),
    ("Dockerfile", "FROM golang:1.22 as b\nFROM b\n", {"GC080", "GC083"}, {"GC081"}),
    ("Dockerfile", "FROM --platform=linux/amd64 node:20-slim\n", {"GC080", "GC081"}, {"GC083"}),
    ("Dockerfile", "FROM img@sha256:abc\n", set(), {"GC080"}),
    ("Dockerfile", "RUN pip install --no-cache-dir a && apt install b\n", {"GC082"}, set()),
    ("Dockerfile", "ADD HTTP://x/y /\nADD a.TGZ /\n", set(), {"GC084"}),
    ("requirements.txt", "torch<3\n\nclick\n", {"GC051", "GC052"}, set()),
    ("requirements-dev.txt", "flask==1\n", set(), {"GC052"}),
    ("sub/requirements.txt", "pandas\n", set(), {"GC051", "GC052"}),
]


def test_flagged_and_not_flagged(spark, files_of):
    files = files_of([(str(i), name, text) for i, (name, text, _, _) in enumerate(PAIRS)])
    got = {}
    for row in cf.violations(cf.scan_files(files)).collect():
        got.setdefault(int(row.repo_id), set()).add(row.rule_id)
    wrong = [
        (PAIRS[i], got.get(i, set()))
        for i, (_, _, there, absent) in enumerate(PAIRS)
        if not there <= got.get(i, set()) or absent & got.get(i, set())
    ]
    assert not wrong


def test_templates_match_their_labels(found_in):
    files = {f"f{i}{t.ext}": t.content for i, t in enumerate(TEMPLATES)}
    expected = sorted((f"f{i}{t.ext}", rule, line) for i, t in enumerate(TEMPLATES) for rule, line in t.labels())
    assert found_in(files) == expected


def test_places_and_snippets(files_of):
    text = "\U0001f600 = 1; x = df.iterrows()\n  y = open('z')  \n"
    rows = cf.violations(cf.scan_files(files_of({"a.js": "é fetch(1)\n", "a.py": text.replace("\U0001f600", "é")}))).collect()
    places = {(r.path, r.rule_id): (r.line, r.column, r.snippet) for r in rows}
    assert places["a.js", "GC023"] == (1, 3, "é fetch(1)")
    # Pattern columns count code points from 1. The second line is indented, so the file does not parse.
    assert places["a.py", "GC006"] == (1, 14, "é = 1; x = df.iterrows()")
    ast = cf.violations(cf.scan_files(files_of({"b.py": "é = open('z')  \n"}))).collect()[0]
    # Syntax columns count UTF-8 bytes from 0.
    assert (ast.rule_id, ast.line, ast.column, ast.snippet) == ("GC011", 1, 5, "é = open('z')")
    astral = cf.violations(cf.scan_files(files_of({"c.js": "'\U0001f600'; fetch(1)\n"}))).collect()[0]
    assert astral.column == 6


def test_words_are_unicode(found_in):
    assert found_in({"a.js": "éfetch(1)\n"}) == []
    assert found_in({"a.go": "éfor x { for { } }"}) == []
    # The long s folds to s when case is ignored, which a lower-cased search would miss.
    assert found_in({"q.sql": "\u017felect * from t where 1\n"}) == [("q.sql", "GC030", 1)]


def test_first_match_per_line_and_rule(found_in):
    assert found_in({"a.js": "fetch(1); fetch(2)\nfetch(3)\n"}) == [("a.js", "GC023", 1), ("a.js", "GC023", 2)]


def test_scrubbed_numbering_when_a_comment_holds_a_line_separator(files_of):
    # The separator inside the comment is blanked, so the scrubbed text has one line fewer than the original.
    row = cf.violations(cf.scan_files(files_of({"a.js": "// a\u2028b\nfetch(1)\n"}))).collect()[0]
    assert (row.line, row.snippet) == (2, "b")


def test_syntax_errors_are_rows_and_other_rules_still_run(files_of):
    files = files_of({
        "a.py": "def broken(:\nprint(1)\n", "b.py": "\ufeffprint(1)\n", "c.py": "x = 1\x00\n", "ok.py": "x = 1\n",
        "d.py": "(" * 5000 + ")" * 5000,
    })
    scanned = cf.scan_files(files)
    assert sorted(r.path for r in cf.errors(scanned).collect()) == ["a.py", "b.py", "c.py", "d.py"]
    assert [(r.path, r.rule_id) for r in cf.violations(scanned).collect()] == [("a.py", "GC040")]


def test_size_and_encoding_gates(files_of):
    files = files_of({
        "at.py": b"x=1\n" + b"#" * (2 * 1024 * 1024 - 4), "over.js": b"fetch(1)\n" + b" " * (2 * 1024 * 1024),
        "bad.py": b"print(1)\n\xff", "pic.png": b"x" * 512001, "small.PNG": b"x" * 512000,
        "lib.min.js": b"x" * 200000, "lib.mjs": b"x" * 153601, "edge.css": b"x" * 153600,
    })
    # without a limit every text is scanned
    assert {r.path: r.code_lines for r in cf.file_stats(cf.scan_files(files)).collect()}["over.js"] == 1
    scanned = cf.scan_files(files, max_text_bytes=2 * 1024 * 1024)
    stats = {r.path: (r.language, r.code_lines) for r in cf.file_stats(scanned).collect()}
    assert stats["at.py"] == ("python", 2)
    assert stats["over.js"] == ("javascript", 0)
    assert stats["bad.py"] == ("python", 0)
    assert stats["pic.png"] == (None, 0)
    found = {r.path: r for r in cf.violations(scanned).collect()}
    assert set(found) == {"over.js", "pic.png", "lib.mjs"}
    assert found["pic.png"].snippet == ".png • 500.0 KB" and found["pic.png"].extra == {"bytes": "512001"}
    assert found["over.js"].rule_id == found["lib.mjs"].rule_id == "GC072"


def test_package_manifests(spark, files_of):
    cases = [
        ('{\n "name": "x",\n "dependencies": {\n  "lodash": "*",\n  "flask": "latest"\n }\n}\n',
         [("GC051", 4), ("GC052", 4), ("GC052", 5)]),
        ('{"dependencies": {"moment": "1.x"}}', [("GC051", 0), ("GC052", 0)]),
        ('{"dependencies": ["pandas"], "devDependencies": {"a": " X "}}', [("GC052", 0)]),
        ('{"dependencies": "{\\"pandas\\": \\"*\\"}"}', []),
        ('{"dependencies": {"pandas": "*"}} trailing', []),
        ("{'dependencies': {'pandas': '*'}}", []),
        ('{"dependencies": {"pandas": "*",}}', []),
        ("[1, 2]", []), ("", []), ("null", []),
        ('{"dependencies": {"a": "*", "a": "1"}}', []),
        ('{"dependencies": {"a": 1, "b": null, "c": {"d": "*"}, "e": true}}', []),
        ('{\n"optionalDependencies": {\n"q\\"r": "x",\n"Torch" : "^1"}}', [("GC051", 4), ("GC052", 0)]),
        ('{\n"peerDependencies": {"x":\n"*"},\n"x": 1}', [("GC052", 4)]),
    ]
    files = files_of([(str(i), "package.json", text) for i, (text, _) in enumerate(cases)])
    got = {}
    for row in cf.violations(cf.scan_files(files)).collect():
        got.setdefault(int(row.repo_id), []).append((row.rule_id, row.line))
    for i, (text, expected) in enumerate(cases):
        assert sorted(got.get(i, [])) == sorted(expected), text


def test_requirements(found_in):
    text = "flask\n\n# note\n-r base.txt\na!=1\nb # pin ==\nPandas[x]~=1\n;x\nc>1\n d \n"
    lines = [line for _, rule, line in found_in({"Requirements.TXT": text}) if rule == "GC052"]
    assert lines == [1, 4, 5, 10]
    assert ("Requirements.TXT", "GC051", 7) in found_in({"Requirements.TXT": text})


def test_manifest_text_drops_undecodable_bytes(found_in):
    assert found_in({"requirements.txt": b"pan\xffdas==1\n\xef\xbf\xbdtorch==1\n"}) == [("requirements.txt", "GC051", 1)]


def test_rule_selection_and_custom_rules(found_in):
    files = {"a.py": "for i in x:\n    for j in y:\n        print(1)\n", "a.js": "for(;;){for(;;){}}"}
    assert {rule for _, rule, _ in found_in(files, rules=select_rules(["GC040"]))} == {"GC040"}
    assert found_in(files, rules=select_rules(["GC001"])) == [("a.js", "GC001", 1), ("a.py", "GC001", 2)]
    assert found_in(files, rules=()) == []
    custom = [Rule("X'1", "Quote's rule", "compute", 2, pattern=r"for\s+\w+", require_absent=r"xs\b", languages=("python",))]
    assert found_in(files, rules=custom) == [("a.py", "X'1", 1), ("a.py", "X'1", 2)]


def test_hints_only_save_work(spark, files_of):
    from dataclasses import replace

    files = files_of({f"f{i}{t.ext}": t.content for i, t in enumerate(TEMPLATES)})
    plain = [replace(r, hints=()) for r in cf.DEFAULT_RULES]

    def scan(rules):
        return sorted((r.path, r.rule_id, r.line, r.column) for r in cf.violations(cf.scan_files(files, rules)).collect())

    assert scan(plain) == scan(cf.DEFAULT_RULES)


def test_sources_without_files(spark):
    rows = [("s", "x.py", "for a in b:\n    for c in d:\n        pass\n", None), ("s", "noname", "print(1)\n", None),
            ("s", "y.py", "SELECT * FROM t;\n", "sql")]
    sources = spark.createDataFrame(rows, "repo_id string, name string, source string, language string")
    scanned = cf.scan_sources(sources)
    assert sorted((r.path, r.rule_id) for r in cf.violations(scanned).collect()) == [
        ("noname", "GC040"), ("x.py", "GC001"), ("y.py", "GC030"), ("y.py", "GC031")]
    assert {r.path: r.language for r in cf.file_stats(scanned).collect()} == {
        "x.py": "python", "noname": "python", "y.py": "sql"}


def test_single_files_bring_their_folders_manifests(spark, files_of):
    files = files_of({"a/b.py": "print(1)\n", "a/requirements.txt": "pandas==1\n", "a/c.py": "print(2)\n",
                      "requirements.txt": "torch==1\n", "a/sub/package.json": "{}"})
    requests = spark.createDataFrame([("r", "a/b.py"), ("r", "a/missing.py")], "repo_id string, path string")
    scanned = cf.scan_files(cf.requested_files(files, requests))
    assert sorted((r.path, r.rule_id) for r in cf.violations(scanned).collect()) == [
        ("b.py", "GC040"), ("requirements.txt", "GC051")]
    assert [r.path for r in cf.file_stats(scanned).collect()] == ["b.py"]


def test_files_read_from_disk(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_text("print(1)\n")
    (tmp_path / "one" / "src" / "__init__.py").write_text("print(1)\n")
    (tmp_path / "one" / ".gitlab-ci.yml").write_text("restart: always\n")

    def scan(files):
        return sorted((r.repo_id, r.path, r.rule_id) for r in cf.violations(cf.scan_files(files)).collect())

    assert scan(cf.files_from_binary(spark, [str(tmp_path)], str(tmp_path))) == [("one", "src/a.py", "GC040")]
    listed = [("one", str(p.relative_to(tmp_path / "one")), p.as_uri()) for p in tmp_path.rglob("*") if p.is_file()]
    files = cf.files_from_listing(spark.createDataFrame(listed, "repo_id string, path string, uri string"))
    assert scan(files) == [
        ("one", ".gitlab-ci.yml", "GC091"), ("one", "src/__init__.py", "GC040"), ("one", "src/a.py", "GC040")]


@pytest.mark.parametrize("lines", [200])
def test_deep_nesting_in_the_fold(found_in, lines):
    text = "".join(f"{'for(;;){'}\n" for _ in range(lines)) + "}" * lines
    assert found_in({"a.c": text}) == [("a.c", "GC001", i) for i in range(2, lines + 1)]


def test_roots_may_be_uris(spark, tmp_path):
    (tmp_path / "one" / "src").mkdir(parents=True)
    (tmp_path / "one" / "src" / "a.py").write_text("print(1)\n")
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/"):
        rows = cf.files_from_binary(spark, [f"file://{tmp_path}"], root).collect()
        assert [(r.repo_id, r.path) for r in rows] == [("one", "src/a.py")]
