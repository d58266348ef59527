"""DuckDB statements for the registered queries.

They are written against the shared tables alone. Corpora are rebuilt in SQL from the same literals, and expected
findings of the code corpus come from the hand labels of :mod:`workloads.templates`, not from our detectors.
"""

from __future__ import annotations

from collections.abc import Iterable

from codefootprint.catalog import CATEGORIES, DEFAULT_RULES, FIX_GUIDES, GRADE_BANDS, HEAVY_DEPENDENCIES, SEVERITIES

from . import corpora as C
from . import nodes
from . import registry as R
from .templates import TEMPLATES


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        # chr() keeps line ends and tabs out of the statement.
        parts = value.replace("'", "''").replace("\n", "'||chr(10)||'").replace("\t", "'||chr(9)||'")
        return f"('{parts}')" if "||" in parts else f"'{parts}'"
    return repr(value)


def values(rows: Iterable[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({columns}))"


def pick(options: Iterable, index: str) -> str:
    """The ``index``-th (from 0) literal."""
    return f"([{', '.join(lit(o) for o in options)}])[CAST({index} AS BIGINT) + 1]"


N = len(TEMPLATES)
EXT_LANGUAGE = {
    ".py": "python", ".js": "javascript", ".go": "go", ".sql": "sql", ".html": "html", ".css": "css", ".yml": "yaml",
    ".json": "json", ".toml": "toml", ".dockerfile": "dockerfile", ".md": None,
}
CODE = {"python", "javascript", "go", "sql", "html", "css", "dockerfile"}

TPL = "tpl AS " + values(
    [(i, t.ext, EXT_LANGUAGE[t.ext], t.content, t.stripped, t.masked, *t.nodes, t.error,
      sum(1 for line in t.content.split("\n") if line.strip())) for i, t in enumerate(TEMPLATES)],
    "t, ext, lang, content, stripped, masked, loops, calls, functions, error, code_lines",
)
LABELS = "labels_t AS " + values(
    [(i, rule, line) for i, t in enumerate(TEMPLATES) for rule, line in t.labels()], "t, rule_id, line"
)
C2 = f"""c2_all AS (
  SELECT e.user_id AS repo_id, e.event_id, tpl.*,
         CASE WHEN event_id % 11 = 0 THEN 'node_modules/' WHEN event_id % 13 = 0 THEN '.cache/' ELSE '' END
         || 'src' || (event_id % 7) || '/f' || event_id || ext AS path
  FROM events e JOIN tpl ON tpl.t = e.event_id % {N}),
c2 AS (SELECT * FROM c2_all WHERE event_id % 11 <> 0 AND event_id % 13 <> 0)"""
CODE_CTES = f"{TPL}, {LABELS}, {C2}"

_NODE_TYPES = {"BOOLEAN": ("async_scope", "func_is_name", "const_true", "is_add", "string_like", "in_literal_seq"),
               "VARCHAR": ("kind", "field", "call_root", "call_attr", "name", "arg0_kind", "decorators")}
_NODE_TYPE = {c: kind for kind, names in _NODE_TYPES.items() for c in names}
NODES = (
    "nodes_t AS (SELECT CAST(t AS INTEGER) AS t, "
    + ", ".join(f'CAST("{c}" AS {_NODE_TYPE.get(c, "INTEGER")}) AS "{c}"' for c in nodes.COLUMNS)
    + f" FROM {values(nodes.rows(), ', '.join(['t', *(chr(34) + c + chr(34) for c in nodes.COLUMNS)]))})"
)

RULES = "rules_t AS " + values(
    [(r.id, r.name, r.category, r.severity) for r in DEFAULT_RULES], "rule_id, name, category, severity"
)
C3 = f"""c3 AS (
  SELECT l_suppkey AS repo_id, {pick((*C.RULE_IDS, 'GC999'), 'l_partkey % 45')} AS rule_id,
         'f' || (l_orderkey % 50) || '.py' AS path, l_linenumber AS line, CAST(l_partkey % 9 AS INTEGER) AS col,
         'order ' || l_orderkey AS snippet, 'part ' || l_partkey AS message
  FROM lineitem),
stats AS (
  SELECT l_suppkey AS repo_id, {pick(('python', 'go', 'yaml'), 'l_orderkey % 3')} AS language,
         CAST(CAST(trunc(l_quantity) AS INTEGER) * (1 + l_suppkey % 9) AS BIGINT) AS code_lines
  FROM lineitem
  UNION ALL
  SELECT s_suppkey + 1000000000, 'rust', 10 + s_suppkey % 90 FROM supplier)"""
FOUND_CTES = f"{RULES}, {C3}"


def with_code(body: str) -> str:
    return f"WITH {CODE_CTES} {body}"


def with_found(body: str) -> str:
    return f"WITH {FOUND_CTES} {body}"


def labelled(rule_ids: Iterable[str], condition: str = "TRUE") -> str:
    wanted = ", ".join(lit(i) for i in rule_ids)
    return with_code(
        f"SELECT repo_id, rule_id, path, CAST(line AS INTEGER) AS line FROM c2 JOIN labels_t USING (t) "
        f"WHERE rule_id IN ({wanted}) AND {condition}"
    )


# ------------------------------------------------------------------ text volume
C1 = """c1 AS (
  SELECT regexp_extract(url, '^https?://([^/?#]*)', 1) AS repo_id, 'p' || page_id || '.html' AS path, 'html' AS language,
         html AS content FROM pages
  UNION ALL
  SELECT source, 'd' || doc_id || (['.md', '.yml', '.txt', '.html'])[doc_id % 4 + 1],
         ([NULL, 'yaml', NULL, 'html'])[doc_id % 4 + 1], text FROM documents)"""
_BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
C1_LINES = f"""cut AS (SELECT repo_id, path, language, content, string_split_regex(content, {_BREAK}) AS parts FROM c1),
c1_lines AS (SELECT repo_id, path, language, octet_length(encode(content)) AS bytes,
                    CASE WHEN parts[-1] = '' THEN parts[:-2] ELSE parts END AS lines FROM cut)"""
_BLANK = r"'^[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*$'"
_NONBLANK = f"CAST(len([x FOR x IN lines IF NOT regexp_matches(x, {_BLANK})]) AS INTEGER)"


# ------------------------------------------------------------------ line patterns
def _sql_pattern(rule, pattern: str) -> str:
    return lit(("(?i)" if rule.ignore_case else "") + pattern)


CODE_LINES = r"""raw_lines AS (
  SELECT repo_id, path, lang, unnest(string_split(rtrim(content, chr(10)), chr(10))) AS raw,
         generate_subscripts(string_split(rtrim(content, chr(10)), chr(10)), 1) AS line FROM c2),
code_lines AS (
  SELECT *, CASE WHEN lang IN ('python', 'yaml', 'dockerfile') THEN regexp_replace(raw, '#.*$', '')
                 WHEN lang IN ('javascript', 'go') THEN regexp_replace(regexp_replace(raw, '/\*.*\*/', ''), '//.*$', '')
                 WHEN lang = 'sql' THEN regexp_replace(raw, '--.*$', '') ELSE raw END AS clean FROM raw_lines)"""


def line_rule(rule) -> str:
    """Findings of one line pattern, with look-aheads written as a second test."""
    languages = "lang IS NOT NULL" if not rule.languages else f"lang IN ({', '.join(map(lit, rule.languages))})"
    if rule.id == "GC032":
        first = r"'(?i)\b(?:update\s+\w+\s+set|delete\s+from\s+\w+)\b'"
        rest = r"regexp_extract(clean, '(?i)\b(?:update\s+\w+\s+set|delete\s+from\s+\w+)\b([^;]*)', 1)"
        test = rf"regexp_matches(clean, {first}) AND NOT regexp_matches({rest}, '(?i)\b(where|limit)\b')"
        matched = f"regexp_extract(clean, {first})"
    elif rule.id == "GC071":
        images = r"[x FOR x IN regexp_extract_all(clean, '(?i)<img\b[^>]*>') IF NOT regexp_matches(x, '(?i)\bloading\s*=')]"
        test, matched = f"len({images}) > 0", f"({images})[1]"
    else:
        pattern = _sql_pattern(rule, rule.pattern)
        test, matched = f"regexp_matches(clean, {pattern})", f"regexp_extract(clean, {pattern})"
        if rule.require_absent:
            test += f" AND NOT regexp_matches(clean, {_sql_pattern(rule, rule.require_absent)})"
    return (
        f"SELECT repo_id, {lit(rule.id)} AS rule_id, path, CAST(line AS INTEGER) AS line, "
        f"CAST(strpos(clean, {matched}) AS INTEGER) AS col, trim(raw) AS snippet "
        f"FROM code_lines WHERE {languages} AND {test}"
    )


def line_rules(rules) -> str:
    return f"WITH {CODE_CTES}, {CODE_LINES} " + " UNION ALL ".join(line_rule(r) for r in rules)


# ------------------------------------------------------------------ Dockerfiles
C6 = f"""c6 AS (
  SELECT l_suppkey AS repo_id, 'svc' || l_orderkey || '/' || l_linenumber || '.Dockerfile' AS path,
         [{pick(C.DOCKER_LINES, 'l_partkey % 12')}, {pick(C.DOCKER_LINES, 'l_partkey % 7 + l_linenumber % 6')},
          {pick(C.DOCKER_LINES, 'l_suppkey % 12')}, {pick(C.DOCKER_LINES, 'l_orderkey % 12')}] AS lines
  FROM lineitem),
c6_lines AS (SELECT repo_id, path, lines, unnest(lines) AS text, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line
             FROM c6)"""
# What each instruction breaks on its own, by hand.
DOCKER_LABELS = {
    "GC080": ("FROM python:latest", "from ubuntu"),
    "GC083": ("FROM python:latest", "from ubuntu", "FROM reg.io/x/golang:1.22"),
    "GC082": ("RUN pip install a", "RUN apt-get install -y b"),
    "GC084": ("ADD a.py /a",),
}
_FROMS = ("FROM python:latest", "FROM node:20-slim AS b", "from ubuntu", "FROM reg.io/x/golang:1.22")


def docker_rule(rule_id: str) -> str:
    if rule_id == "GC081":
        is_from = f"x IN ({', '.join(map(lit, _FROMS))})"
        first = f"([x FOR x IN lines IF {is_from}])[1]"
        heavy = "list_has_any(lines, ['FROM python:latest', 'FROM reg.io/x/golang:1.22'])"
        return (
            f"SELECT repo_id, 'GC081' AS rule_id, path, CAST(list_position(lines, {first}) AS INTEGER) AS line, "
            f"{first} AS snippet FROM c6 WHERE NOT list_contains(lines, 'FROM node:20-slim AS b') AND {heavy}"
        )
    wanted = ", ".join(map(lit, DOCKER_LABELS[rule_id]))
    return (
        f"SELECT repo_id, {lit(rule_id)} AS rule_id, path, line, text AS snippet FROM c6_lines WHERE text IN ({wanted})"
    )


def docker_rules(ids) -> str:
    return f"WITH {C6} " + " UNION ALL ".join(docker_rule(i) for i in ids)


# ------------------------------------------------------------------ manifests
def _entry(offset: int) -> tuple[str, str]:
    name = pick(C.PACKAGES, f"(p_partkey + {offset}) % 6")
    return name, f"{name} || {pick(C.REQUIREMENT_TAILS, f'(p_size + {offset}) % 6')}"


_SUB = "CASE WHEN p_partkey % 10 = 9 THEN 'sub/' ELSE '' END"
REQ = f"""req_all AS (
  SELECT p_partkey AS repo_id, {_SUB} || 'requirements' || (['', '-dev'])[p_partkey % 2 + 1] || '.txt' AS path,
         unnest(['-r base.txt', {_entry(0)[1]}, '', '# pandas', upper({_entry(1)[1]}), {_entry(2)[1]}]) AS text,
         unnest(['-r', {_entry(0)[0]}, '', '', {_entry(1)[0]}, {_entry(2)[0]}]) AS name,
         unnest([1, 2, 3, 4, 5, 6]) AS line FROM part),
req AS (SELECT * FROM req_all WHERE repo_id % 10 <> 9)"""
_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
PKG = f"""pkg_parts AS (
  SELECT p_partkey AS repo_id, p_partkey % 10 AS kind, {_SUB} || 'package.json' AS path,
         {pick(_SECTIONS, 'p_size % 4')} AS section,
         [{pick(C.PACKAGES, 'p_partkey % 6')}, {pick(C.PACKAGES, '(p_partkey + 1) % 6')}] AS names,
         [{pick(C.PACKAGE_VERSIONS, 'p_size % 5')}, {pick(C.PACKAGE_VERSIONS, '(p_size + 1) % 5')}] AS versions
  FROM part WHERE p_partkey % 10 <> 7),
pkg_all AS (
  SELECT repo_id, kind, path, section, names[1] AS name, versions[1] AS version, 4 AS line,
         '"' || names[1] || '": "' || versions[1] || '",' AS text FROM pkg_parts WHERE kind <> 8
  UNION ALL
  SELECT repo_id, kind, path, section, names[2], versions[2], 5, '"' || names[2] || '": "' || versions[2] || '"'
  FROM pkg_parts WHERE kind <> 8
  UNION ALL
  SELECT repo_id, kind, path, 'devDependencies', names[2], versions[2], 4,
         '"' || names[2] || '": "' || versions[2] || '"' FROM pkg_parts WHERE kind = 8),
pkg AS (SELECT * FROM pkg_all WHERE kind <> 9)"""
_HEAVY = "(" + ", ".join(lit(n) for n, _ in HEAVY_DEPENDENCIES) + ")"
_LOOSE = r"(text <> '' AND text NOT LIKE '#%' AND name <> '' AND NOT regexp_matches(text, '==|~=|>|<'))"
_OPEN = "(version IN ('*', 'x', 'latest') OR version LIKE '%.x')"


def _manifest(rule_id: str, table: str, condition: str) -> str:
    return (
        f"SELECT repo_id, {lit(rule_id)} AS rule_id, path, CAST(line AS INTEGER) AS line, text AS snippet "
        f"FROM {table} WHERE {condition}"
    )


# ------------------------------------------------------------------ assets
C4 = f"""c4 AS (
  SELECT l_suppkey AS repo_id, {pick(C.ASSET_EXTENSIONS, 'l_partkey % 12')} AS ext,
         'a/' || l_orderkey || '-' || l_linenumber AS stem,
         CAST(round(l_extendedprice * l_quantity) AS BIGINT) AS length FROM lineitem)"""


def _size(column: str) -> str:
    return (
        f"CASE WHEN {column} < 1024 THEN {column} || ' B' "
        f"WHEN {column} < 1048576 THEN format('{{:.1f}} KB', {column} / 1024.0::DOUBLE) "
        f"WHEN {column} < 1073741824 THEN format('{{:.1f}} MB', {column} / 1048576.0::DOUBLE) "
        f"ELSE format('{{:.1f}} GB', {column} / 1073741824.0::DOUBLE) END"
    )


def _asset(rule_id: str, condition: str) -> str:
    shown = "CASE WHEN ext = '.min.js' THEN '.js' ELSE ext END"
    return (
        f"WITH {C4} SELECT repo_id, {lit(rule_id)} AS rule_id, stem || ext AS path, CAST(0 AS INTEGER) AS line, "
        f"{shown} || ' • ' || {_size('length')} AS snippet, CAST(length AS VARCHAR) AS bytes FROM c4 WHERE {condition}"
    )


# ------------------------------------------------------------------ scores
def _band(score: str, position: int) -> str:
    cases = " ".join(f"WHEN {score} >= {b[1]!r} THEN {lit(b[position])}" for b in GRADE_BANDS[:-1])
    return f"CASE {cases} ELSE {lit(GRADE_BANDS[-1][position])} END"


_CODE_SQL = "('javascript','typescript','java','c','cpp','csharp','go','rust','kotlin','swift','scala','php'," \
            "'python','ruby','sql','css','html','dockerfile')"


def _scores(k: float | str) -> str:
    """Per repository totals and score; needs ``stats``, ``c3`` and ``rules_t``."""
    return f"""file_totals AS (
  SELECT repo_id, count(*) AS total_files, count(*) FILTER (language IN {_CODE_SQL}) AS code_files,
         CAST(coalesce(sum(code_lines) FILTER (language IN {_CODE_SQL}), 0) AS BIGINT) AS total_code_lines
  FROM stats GROUP BY repo_id),
found_totals AS (
  SELECT repo_id, count(*) AS total_violations, CAST(coalesce(sum(severity), 0) AS BIGINT) AS penalty
  FROM c3 LEFT JOIN rules_t USING (rule_id) GROUP BY repo_id),
raw_scores AS (
  SELECT f.*, coalesce(total_violations, 0) AS total_violations, coalesce(penalty, 0) AS penalty,
         coalesce(penalty, 0)::DOUBLE / greatest(greatest(total_code_lines, 1)::DOUBLE / 1000.0::DOUBLE, 0.1::DOUBLE) AS density
  FROM file_totals f LEFT JOIN found_totals USING (repo_id)),
scores AS (
  SELECT *, CAST(format('{{:.1f}}', greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - ({k})::DOUBLE * density))) AS DOUBLE) AS score,
         penalty * 0.05::DOUBLE AS kwh, penalty * 0.05::DOUBLE * 0.3::DOUBLE AS kg_co2
  FROM raw_scores)"""


_SCORE_COLUMNS = (
    "repo_id, code_files, total_code_lines, total_violations, penalty, round(density, 6) AS density, score, "
    f"{_band('score', 0)} AS grade, {_band('score', 2)} AS grade_color, {_band('score', 3)} AS grade_label, "
    "round(kwh, 6) AS kwh, round(kg_co2, 6) AS kg_co2"
)
CATS = "cats AS " + values([(i, *c) for i, c in enumerate(CATEGORIES)], "ord, category, label, color")
_CATEGORY = f"""{CATS}, per_category AS (
  SELECT repo_id, category, label, color, ord, count(*) AS "count", CAST(sum(severity) AS BIGINT) AS penalty
  FROM c3 JOIN rules_t USING (rule_id) JOIN cats USING (category) GROUP BY ALL),
category_t AS (
  SELECT *, penalty::DOUBLE / sum(penalty) OVER (PARTITION BY repo_id) * 100.0::DOUBLE AS percent_of_penalty,
         CAST(row_number() OVER (PARTITION BY repo_id ORDER BY penalty DESC, ord) AS INTEGER) AS rank
  FROM per_category)"""
_RULE = """per_rule AS (
  SELECT repo_id, rule_id, category, severity, count(*) AS "count", CAST(sum(severity) AS BIGINT) AS penalty
  FROM c3 JOIN rules_t USING (rule_id) GROUP BY ALL),
rule_t AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY penalty DESC, "count" DESC, rule_id) AS INTEGER) AS rank
  FROM per_rule)"""
_SEV = "sev AS " + values(SEVERITIES, "severity, severity_label")
_LOCATION = "CASE WHEN line > 0 THEN path || ':' || line ELSE path END"

# Code corpus as C3-shaped tables, from the labels.
_CODE_AS_FOUND = f"""{RULES}, c3 AS (SELECT repo_id, rule_id FROM c2 JOIN labels_t USING (t)),
stats AS (SELECT repo_id, lang AS language, code_lines FROM c2)"""

GUIDES = "guides AS " + values(
    [(i, len(g.steps), g.bad, g.good, g.language, g.has_example) for i, g in FIX_GUIDES.items()],
    "rule_id, steps, bad, good, language, has_example",
)


def _totals(source: str) -> str:
    return (
        f"SELECT count(*) AS repos, round(coalesce(sum(greatest(value - 50, 0)), 0), 2) AS kwh FROM {source} "
        "WHERE event_type <> 'view'"
    )


def _revised(version: int) -> str:
    return pick([C.revised(i, version) for i in range(N)], f"event_id % {N}")


# The last version of every file, by its labels; the path keeps the first version's extension, which later ones share.
REVISED = f"""{TPL}, {LABELS}, c2 AS (
  SELECT e.user_id AS repo_id, tpl.t, tpl.lang, tpl.code_lines, 'src' || (event_id % 7) || '/f' || event_id || ext AS path
  FROM (SELECT *, CASE WHEN event_id % 9 = 0 THEN {_revised(2)} WHEN event_id % 3 = 0 THEN {_revised(1)}
                       ELSE event_id % {N} END AS last FROM events) e
  JOIN tpl ON tpl.t = e.last WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 27 <> 0)"""

# Findings of every repository's own rules: labels of the catalogue's, and a plain search for the two custom ones.
def _profiled() -> str:
    custom = ", ".join(lit(r.id) for r in R.CUSTOM_RULES)
    chosen = ", ".join(lit(r.id) for r in DEFAULT_RULES if r.category in R.PROFILE_CATEGORIES)
    return f"""{CODE_CTES}, open_dirs AS (SELECT * FROM c2), lines_t AS ({_custom_lines(every=True)}),
every_t AS (
  SELECT repo_id, rule_id, path, CAST(line AS INTEGER) AS line FROM c2 JOIN labels_t USING (t)
  UNION ALL SELECT repo_id, 'XX001', path, CAST(line AS INTEGER) FROM lines_t
  WHERE lang = 'python' AND regexp_matches(clean, '\\bfor\\s+\\w+\\s+in\\b')
  UNION ALL SELECT repo_id, 'XX002', path, CAST(line AS INTEGER) FROM lines_t
  WHERE lang IS NOT NULL AND contains(clean, '*') AND NOT contains(clean, 'import')),
profiled AS (
  SELECT * FROM every_t WHERE CASE WHEN repo_id % 5 = 0 OR repo_id % 4 = 0 THEN TRUE
    WHEN repo_id % 4 = 1 THEN rule_id IN ({chosen}) WHEN repo_id % 4 = 2 THEN rule_id IN ({custom}) ELSE FALSE END)"""


def build() -> dict[str, str]:
    by_id = {r.id: r for r in DEFAULT_RULES}
    place = "SELECT repo_id, rule_id, path, CAST(line AS INTEGER) AS line FROM"
    everything = [r.id for r in DEFAULT_RULES]
    as_python = values([("GC030", 1), ("GC031", 1), ("GC040", 2)], "rule_id, line")
    path_languages = (
        "dockerfile", "dockerfile", "dockerfile", None, "ini", None, "python", "python", "html", "css", None,
        "typescript", None, None, "kotlin", "ini",
    )
    sql = {
        "scan_corpus": f"WITH {C1}, {C1_LINES} SELECT repo_id, path, language, {_NONBLANK} AS code_lines, "
                       "CAST(bytes AS BIGINT) AS bytes FROM c1_lines",
        "prune_ignored_dirs": with_code("SELECT repo_id, path, CAST(octet_length(encode(content)) AS BIGINT) AS length FROM c2"),
        "scan_single_file": f"""WITH {REQ}, {PKG},
  r AS (SELECT repo_id, path, CAST(count(*) FILTER (name IN {_HEAVY}) + count(*) FILTER ({_LOOSE}) AS INTEGER) AS findings
        FROM req_all GROUP BY ALL),
  p AS (SELECT repo_id, CAST(count(*) FILTER (name IN {_HEAVY}) + count(*) FILTER ({_OPEN}) AS INTEGER) AS findings
        FROM pkg_all GROUP BY ALL)
SELECT repo_id, CASE WHEN repo_id % 10 = 9 THEN 'sub/' ELSE '' END AS folder, replace(path, 'sub/', '') AS path,
       FALSE AS scanned, CAST(NULL AS VARCHAR) AS language, findings FROM r
UNION ALL
SELECT p_partkey, CASE WHEN p_partkey % 10 = 9 THEN 'sub/' ELSE '' END, 'package.json', TRUE, 'json',
       coalesce(findings, 0) FROM part LEFT JOIN p ON p.repo_id = p_partkey""",
        "scan_source_table": f"WITH {CODE_CTES} {place} c2_all JOIN labels_t USING (t) "
                             f"UNION ALL {place} c2_all, {as_python} WHERE lang IS NULL",
        "admit_snippets": """WITH s AS (
  SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN ' ' || chr(10) || chr(9) || ' ' WHEN doc_id % 7 = 0 THEN repeat(text || 'è', 200) ELSE text END AS source
  FROM documents),
r AS (SELECT *, CASE WHEN trim(coalesce(source, ''), ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'blank'
  WHEN octet_length(encode(source)) > 200000 THEN 'too large' END AS reason FROM s)
SELECT doc_id AS name, (['python', 'sql', 'python', 'go', 'python'])[doc_id % 5 + 1] AS language,
       CAST(octet_length(encode(source)) AS BIGINT) AS bytes,
  reason IS NULL AS admitted, reason FROM r""",
        "missing_repo_errors": """SELECT DISTINCT s_suppkey * 3 AS repo_id, CAST(NULL AS VARCHAR) AS path,
  'No such repository: ' || (s_suppkey * 3) AS message
FROM supplier WHERE s_suppkey * 3 NOT IN (SELECT l_suppkey FROM lineitem)""",
        "decode_text": """SELECT doc_id, CASE WHEN doc_id % 3 <> 1 THEN CAST(length(text) AS INTEGER) END AS chars,
  CASE WHEN doc_id % 3 <> 1 THEN md5(text) END AS digest FROM documents""",
        "size_cutoff": f"""WITH {C4} SELECT repo_id, stem || ext AS path,
  CASE ext WHEN '.js' THEN 'javascript' WHEN '.mjs' THEN 'javascript' WHEN '.min.js' THEN 'javascript'
           WHEN '.css' THEN 'css' WHEN '.ts' THEN 'typescript' END AS language,
  CAST(CASE WHEN ext IN ('.js', '.mjs', '.min.js', '.css', '.ts', '.txt') AND length <= 2097152 THEN 2 ELSE 0 END AS INTEGER) AS code_lines,
  length AS bytes, CASE WHEN ext NOT IN ('.js', '.mjs', '.min.js', '.css', '.ts', '.txt') THEN 'asset'
    WHEN length > 2097152 THEN 'over the limit' WHEN ext = '.txt' THEN 'unknown language' ELSE 'scanned' END AS status
FROM c4""",
        "admit_repos": """WITH m AS (
  SELECT CASE WHEN l_linenumber <= 3 THEN 'big-' || l_returnflag
              ELSE 's' || l_suppkey || '-' || (l_partkey % (2 + l_suppkey % 2)) END AS repo_id,
         l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0 AS safe,
         CAST(round(l_extendedprice * l_quantity) AS BIGINT) AS length, l_suppkey % 40 * 1000000 AS archive FROM lineitem),
t AS (SELECT repo_id, count(*) FILTER (safe) AS files, CAST(coalesce(sum(length) FILTER (safe), 0) AS BIGINT) AS bytes,
             max(archive) AS archive FROM m GROUP BY repo_id),
r AS (SELECT *, CASE WHEN archive > 31457280 THEN 'archive too large' WHEN files > 6000 THEN 'too many files'
                     WHEN bytes > 209715200 THEN 'too large' END AS reason FROM t)
SELECT repo_id, files, bytes, reason IS NULL AS admitted, reason FROM r""",
        "scan_listing": with_code(
            "SELECT repo_id, path, lang AS language, CAST(code_lines AS INTEGER) AS code_lines, "
            "CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM c2"
        ),
        "admitted_files": """WITH m AS (
  SELECT CASE WHEN l_linenumber <= 3 THEN 'big-' || l_returnflag
              ELSE 's' || l_suppkey || '-' || (l_partkey % (2 + l_suppkey % 2)) END AS repo_id, 'x/' || l_orderkey AS path,
         l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0 AS safe,
         CAST(round(l_extendedprice * l_quantity) AS BIGINT) AS length, l_suppkey % 40 * 1000000 AS archive FROM lineitem),
t AS (SELECT repo_id FROM m GROUP BY repo_id HAVING max(archive) <= 31457280 AND count(*) FILTER (safe) <= 6000
      AND coalesce(sum(length) FILTER (safe), 0) <= 209715200)
SELECT repo_id, path, length, md5('text of ' || path) AS digest FROM m JOIN t USING (repo_id) WHERE safe""",
        "normalize_targets": """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages),
s AS (SELECT page_id, host, unnest([0, 1, 2, 3, 4, 5, 6, 7, 8]) AS shape FROM p)
SELECT page_id, CAST(shape AS INTEGER) AS shape, CASE WHEN shape BETWEEN 1 AND 4 THEN host END AS owner,
       CASE WHEN shape BETWEEN 1 AND 4 THEN 'r' || page_id END AS repo FROM s""",
        "detect_language": f"""SELECT 'd/' || l_orderkey || '/' || {pick(R.PATHS, f'l_partkey % {len(R.PATHS)}')} AS path,
  {pick(path_languages, f'l_partkey % {len(R.PATHS)}')} AS language FROM lineitem""",
        "count_code_lines": f"WITH {C1}, {C1_LINES} SELECT repo_id, path, {_NONBLANK} AS code_lines FROM c1_lines",
        "explode_lines": f"WITH {C1}, {C1_LINES} SELECT repo_id, path, "
                         "CAST(generate_subscripts(lines, 1) AS INTEGER) AS line, unnest(lines) AS text FROM c1_lines",
        "strip_comments": with_code("SELECT path, stripped AS text FROM c2_all"),
        "mask_code": with_code("SELECT path, masked AS text FROM c2_all"),
        "human_size": f"""WITH s AS (SELECT CAST(trunc(pow(l_extendedprice / 100, l_linenumber % 4 + 1)) AS BIGINT) AS length
  FROM lineitem) SELECT length, {_size('length')} AS label FROM s""",
        "label_violations": f"""WITH {FOUND_CTES}, {CATS}, {_SEV} SELECT repo_id, rule_id, path, line, severity_label,
  label AS category_label FROM c3 LEFT JOIN rules_t USING (rule_id) LEFT JOIN sev USING (severity)
  LEFT JOIN cats USING (category)""",
        "grade_scores": f"SELECT event_id, value AS score, {_band('value', 0)} AS grade, {_band('value', 2)} AS grade_color, "
                        f"{_band('value', 3)} AS grade_label FROM events",
        "impact_estimate": """SELECT l_orderkey, l_linenumber, l_partkey AS penalty,
  CAST(format('{:.2f}', l_partkey * 0.05::DOUBLE) AS DOUBLE) AS kwh,
  CAST(format('{:.2f}', l_partkey * 0.05::DOUBLE * 0.3::DOUBLE) AS DOUBLE) AS kg_co2 FROM lineitem""",
        "regex_rules": line_rules([by_id[i] for i in R.REGEX_IDS]),
        **{i.lower(): line_rules([by_id[i]]) for i in R.REGEX_IDS},
        "gc001_clike": labelled(("GC001",), "lang <> 'python'"),
        "gc001_py": labelled(("GC001",), "lang = 'python'"),
        "py_nodes": f"WITH {CODE_CTES}, {NODES} SELECT repo_id, path, n.* EXCLUDE (t) FROM c2 JOIN nodes_t n USING (t)",
        "py_node_stats": with_code(
            "SELECT path, CAST(loops AS BIGINT) AS loops, CAST(calls AS BIGINT) AS calls, "
            "CAST(functions AS BIGINT) AS functions FROM c2 WHERE lang = 'python' AND loops + calls + functions > 0"
        ),
        "py_syntax_errors": with_code("SELECT repo_id, path, TRUE AS is_syntax_error FROM c2 WHERE error"),
        "python_rules": labelled(R.PYTHON_AST_IDS),
        **{i.lower(): labelled((i,)) for i in R.PYTHON_AST_IDS},
        "docker_rules": docker_rules(R.DOCKER_IDS),
        **{i.lower(): docker_rules((i,)) for i in R.DOCKER_IDS},
        "requirement_entries": f"WITH {REQ} SELECT repo_id, path, CAST(line AS INTEGER) AS line, name, text FROM req",
        "package_entries": f"WITH {PKG} SELECT repo_id, path, section, name, version FROM pkg",
        "dependency_line": f"WITH {PKG} SELECT repo_id, name, CAST(line AS INTEGER) AS line, text FROM pkg",
        "gc051": f"WITH {REQ}, {PKG} {_manifest('GC051', 'req', f'name IN {_HEAVY}')} UNION ALL "
                 f"{_manifest('GC051', 'pkg', f'name IN {_HEAVY}')}",
        "gc052_requirements": f"WITH {REQ} {_manifest('GC052', 'req', _LOOSE)}",
        "gc052_package": f"WITH {PKG} {_manifest('GC052', 'pkg', _OPEN)}",
        "gc070": _asset("GC070", "(ext IN ('.png', '.jpg', '.ico') AND length > 512000) OR "
                                 "(ext IN ('.mp4', '.zip', '.gz') AND length > 2097152)"),
        "gc072": _asset("GC072", "ext IN ('.js', '.mjs', '.css') AND length > 153600"),
        "subset_rules": labelled(R.SUBSET),
        "custom_rules": f"""WITH {CODE_CTES}, open_dirs AS (SELECT * FROM c2_all WHERE event_id % 13 <> 0 OR event_id % 11 = 0)
SELECT repo_id, 'XX001' AS rule_id, path, CAST(line AS INTEGER) AS line FROM ({_custom_lines()})
WHERE lang = 'python' AND regexp_matches(clean, '\\bfor\\s+\\w+\\s+in\\b')
UNION ALL
SELECT repo_id, 'XX002', path, CAST(line AS INTEGER) FROM ({_custom_lines()})
WHERE lang IS NOT NULL AND contains(clean, '*') AND NOT contains(clean, 'import')""",
        "free_text_rules": f"WITH {C1}, {C1_LINES}, t AS (SELECT repo_id, path, unnest(lines) AS x, "
                           "generate_subscripts(lines, 1) AS line FROM c1_lines WHERE language = 'html') "
                           + " UNION ALL ".join(
                               f"SELECT repo_id, {lit(r.id)} AS rule_id, path, CAST(line AS INTEGER) AS line, "
                               f"CAST(strpos(x, regexp_extract(x, {_sql_pattern(r, r.pattern)})) AS INTEGER) AS col FROM t "
                               f"WHERE regexp_matches(x, {_sql_pattern(r, r.pattern)})"
                               + (f" AND NOT regexp_matches(x, {_sql_pattern(r, r.require_absent)})" if r.require_absent else "")
                               for r in R.FREE_TEXT_RULES),
        "profiled_violations": f"WITH {_profiled()} SELECT * FROM profiled",
        "profiled_violations_joined": f"WITH {_profiled()} SELECT * FROM profiled",
        "profiled_scores": f"WITH {_profiled()}, "
                           + "rules_t AS " + values([(r.id, r.severity) for r in (*DEFAULT_RULES, *R.CUSTOM_RULES)], "rule_id, severity")
                           + f", c3 AS (SELECT repo_id, rule_id FROM profiled), "
                           f"stats AS (SELECT repo_id, lang AS language, code_lines FROM c2), "
                           + _scores("CASE WHEN repo_id % 5 = 0 THEN 1.0 ELSE 1 + repo_id % 3 * 0.5 END")
                           + f" SELECT repo_id, total_files, total_violations, penalty, round(density, 6) AS density, score, "
                           f"{_band('score', 0)} AS grade FROM scores",
        "all_violations": labelled(everything),
        "code_file_stats": with_code(
            "SELECT repo_id, path, lang AS language, CAST(code_lines AS INTEGER) AS code_lines, "
            "CAST(octet_length(encode(content)) AS BIGINT) AS bytes FROM c2"
        ),
        "scan_scores": f"WITH {CODE_CTES}, {_CODE_AS_FOUND}, {_scores(1.0)} SELECT repo_id, total_files, code_files, "
                       f"total_code_lines, total_violations, penalty, round(density, 6) AS density, score, "
                       f"{_band('score', 0)} AS grade FROM scores",
        "scan_requested": f"""WITH {CODE_CTES}, {_CODE_AS_FOUND}, {_scores(1.0)},
requested AS (SELECT DISTINCT user_id * 2 AS repo_id FROM events)
SELECT repo_id, coalesce(total_files, 0) AS total_files, coalesce(penalty, 0) AS penalty, coalesce(score, 100.0::DOUBLE) AS score,
       {_band('coalesce(score, 100)', 0)} AS grade FROM requested LEFT JOIN scores USING (repo_id)""",
        "join_rules_inner": with_found("SELECT repo_id, rule_id, path, line, category, CAST(severity AS INTEGER) AS severity "
                                       "FROM c3 JOIN rules_t USING (rule_id)"),
        "join_rules_left": with_found("SELECT repo_id, rule_id, path, line, category, CAST(severity AS INTEGER) AS severity "
                                      "FROM c3 LEFT JOIN rules_t USING (rule_id)"),
        "violations_with_fix": f"WITH {FOUND_CTES}, {GUIDES} SELECT repo_id, rule_id, path, line, "
                               "CAST(steps AS INTEGER) AS steps, bad, good, language, has_example "
                               "FROM c3 JOIN rules_t USING (rule_id) LEFT JOIN guides USING (rule_id)",
        "catalog_integrity": f"""WITH {FOUND_CTES}, {GUIDES}, seen AS (SELECT rule_id, count(*) AS findings FROM c3 GROUP BY ALL)
SELECT 'no rule' AS problem, rule_id, findings FROM seen WHERE rule_id NOT IN (SELECT rule_id FROM rules_t)
UNION ALL SELECT 'no guide', rule_id, findings FROM seen WHERE rule_id NOT IN (SELECT rule_id FROM guides)
UNION ALL SELECT 'guide without rule', rule_id, 0 FROM guides WHERE rule_id NOT IN (SELECT rule_id FROM rules_t)""",
        "repo_stats": with_found(
            f"SELECT repo_id, count(*) AS total_files, count(*) FILTER (language IN {_CODE_SQL}) AS code_files, "
            f"CAST(coalesce(sum(code_lines) FILTER (language IN {_CODE_SQL}), 0) AS BIGINT) AS total_code_lines "
            "FROM stats GROUP BY repo_id"
        ),
        "language_breakdown": with_found(
            "SELECT repo_id, language, CAST(sum(code_lines) AS BIGINT) AS code_lines FROM stats GROUP BY ALL"
        ),
        "repo_scores": f"WITH {FOUND_CTES}, {_scores(1.0)} SELECT {_SCORE_COLUMNS} FROM scores",
        "repo_scores_k2": f"WITH {FOUND_CTES}, {_scores(2.0)} SELECT {_SCORE_COLUMNS} FROM scores",
        "category_scores": f"WITH {FOUND_CTES}, {_CATEGORY} SELECT repo_id, category, label, color, \"count\", penalty, "
                           "round(percent_of_penalty, 6) AS percent_of_penalty, rank FROM category_t",
        "rule_scores": f"WITH {FOUND_CTES}, {_RULE} SELECT repo_id, rule_id, category, CAST(severity AS INTEGER) AS severity, "
                       "\"count\", penalty, rank FROM rule_t",
        "quality_gate": f"WITH {FOUND_CTES}, {_scores(1.0)} SELECT repo_id, score, {_band('score', 0)} AS grade "
                        f"FROM scores WHERE score < {R.MIN_SCORE!r}",
        "sorted_violations": with_found("SELECT repo_id, CAST(severity AS INTEGER) AS severity, path, line, col, rule_id "
                                        "FROM c3 JOIN rules_t USING (rule_id)"),
        "top_violations": with_found(
            f"""SELECT repo_id, CAST(rank AS INTEGER) AS rank, rule_id, CAST(severity AS INTEGER) AS severity, {_LOCATION} AS location,
  snippet FROM (
    SELECT c3.*, coalesce(severity, 0) AS severity, row_number() OVER (
      PARTITION BY repo_id ORDER BY coalesce(severity, 0) DESC, path, line, col, rule_id, snippet) AS rank
    FROM c3 LEFT JOIN rules_t USING (rule_id)) WHERE rank <= 15"""
        ),
        "top_rules": f"WITH {FOUND_CTES}, {_RULE} SELECT repo_id, rank, rule_id, CAST(severity AS INTEGER) AS severity, "
                     "\"count\", penalty FROM rule_t WHERE rank <= 8",
        "top_rules_page": f"WITH {FOUND_CTES}, {_RULE} SELECT repo_id, rank, rule_id, CAST(severity AS INTEGER) AS severity, "
                          "\"count\", penalty FROM rule_t WHERE rank <= 10",
        "top_per_rule": with_found(
            f"""SELECT repo_id, rule_id, CAST(rank AS INTEGER) AS rank, {_LOCATION} AS location, snippet, "count",
  greatest("count" - 25, 0) AS others FROM (
    SELECT c3.*, row_number() OVER (PARTITION BY repo_id, rule_id ORDER BY path, line, col, snippet) AS rank,
           count(*) OVER (PARTITION BY repo_id, rule_id) AS "count"
    FROM c3 JOIN rules_t USING (rule_id)) WHERE rank <= 25"""
        ),
        "rule_catalog": f"""WITH {FOUND_CTES}, {CATS}, {_SEV}, seen AS (SELECT rule_id, count(*) AS n FROM c3 GROUP BY ALL)
SELECT CAST(ord AS INTEGER) AS ord, category, rule_id, CAST(severity AS INTEGER) AS severity, severity_label,
       coalesce(n, 0) AS findings
FROM rules_t JOIN cats USING (category) JOIN sev USING (severity) LEFT JOIN seen USING (rule_id)""",
        "report_json": f"""WITH {FOUND_CTES}, {_scores(1.0)}, {_CATEGORY}, {_RULE},
c AS (SELECT repo_id, category, percent_of_penalty FROM category_t WHERE rank = 1),
r AS (SELECT repo_id, arg_min(rule_id, rank) AS first_rule, count(*) AS rules FROM rule_t GROUP BY repo_id),
g AS (SELECT repo_id, CAST(sum(code_lines) AS BIGINT) AS go_lines FROM stats WHERE language = 'go' GROUP BY repo_id)
SELECT repo_id, CAST(repo_id AS VARCHAR) AS repository, score, {_band('score', 0)} AS grade, penalty,
       CAST(format('{{:.2f}}', density) AS DOUBLE) AS density, total_violations, CAST(format('{{:.2f}}', kwh) AS DOUBLE) AS kwh,
       category AS first_category, CAST(format('{{:.1f}}', percent_of_penalty) AS DOUBLE) AS first_percent, first_rule,
       CAST(coalesce(rules, 0) AS INTEGER) AS rules, total_files, coalesce(go_lines, 0) AS go_lines
FROM scores LEFT JOIN c USING (repo_id) LEFT JOIN r USING (repo_id) LEFT JOIN g USING (repo_id)""",
        "report_findings": with_found("SELECT repo_id, rule_id, category, CAST(severity AS INTEGER) AS severity, path, line, col, "
                                      "message, snippet FROM c3 LEFT JOIN rules_t USING (rule_id)"),
        "tabular_sink": f"WITH {CODE_CTES}, {_CODE_AS_FOUND}, {_scores(1.0)} SELECT repo_id, total_files, total_violations, "
                        f"penalty, score, {_band('score', 0)} AS grade FROM scores",
        "run_outputs": f"WITH {CODE_CTES}, {_CODE_AS_FOUND}, {_scores(1.0)}, bad AS (SELECT repo_id, count(*) AS n FROM c2 WHERE error "
                       "GROUP BY repo_id) SELECT repo_id, score, total_violations, total_violations AS violations, "
                       "total_violations AS findings, coalesce(bad.n, 0) AS report_errors FROM scores LEFT JOIN bad USING (repo_id)",
        "usage_totals": _totals("events"),
        "usage_totals_stream": _totals("events"),
        "stream_scan": labelled(everything),
        "stream_scores": f"WITH {REVISED}, {_CODE_AS_FOUND}, {_scores(1.0)} SELECT repo_id, total_files, code_files, "
                         f"total_code_lines, total_violations, penalty, round(density, 6) AS density, score, "
                         f"{_band('score', 0)} AS grade FROM scores",
        "stream_files": f"WITH {REVISED} SELECT repo_id, rule_id, path, CAST(line AS INTEGER) AS line "
                        "FROM c2 JOIN labels_t USING (t)",
    }
    return sql


def _custom_lines(every: bool = False) -> str:
    """Comment-free lines of the corpus when only the folder ``src3`` and hidden folders are left out, or of every folder."""
    cut = "string_split(rtrim(content, chr(10)), chr(10))"
    return f"""SELECT *, CASE WHEN lang IN ('python', 'yaml', 'dockerfile') THEN regexp_replace(raw, '#.*$', '')
    WHEN lang IN ('javascript', 'go') THEN regexp_replace(regexp_replace(raw, '/\\*.*\\*/', ''), '//.*$', '')
    WHEN lang = 'sql' THEN regexp_replace(raw, '--.*$', '') ELSE raw END AS clean
  FROM (SELECT repo_id, path, lang, unnest({cut}) AS raw, generate_subscripts({cut}, 1) AS line FROM open_dirs
        WHERE {every} OR path NOT LIKE '%src3/%')"""
