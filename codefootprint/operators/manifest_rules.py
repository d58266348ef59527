"""Dependencies declared in the root folder's ``requirements*.txt`` and ``package.json``.

Both parsers are column expressions on one file row. The entry arrays are also available as tables
(:func:`requirement_entries`, :func:`package_entries`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.dimensions import HEAVY_DEPENDENCIES
from ..catalog.rules import Rule
from ..functions.layers import with_layers
from ..functions.sqltext import in_list, map_of, quote, regex
from ..functions.text import split_lines_sql, strip_sql, universal_newlines_sql
from .finding import NO_FINDINGS, concat_sql, finding_sql, keep_hits_sql

# Manifest sections, version marks and open versions.
SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
NAME_END = r"[=<>!~\[ ;#]"
VERSION_MARK = r"==|~=|>=|<=|>|<"
OPEN_VERSIONS = ("*", "x", "latest")

_MANIFEST = "array<struct<" + ",".join(f"{name}:map<string,string>" for name in SECTIONS) + ">>"
_ENTRY = "STRUCT<section: STRING, key: STRING, name: STRING, version: STRING>"


def is_requirements_sql(path: str) -> str:
    return f"(startswith(lower({path}), 'requirements') AND endswith(lower({path}), '.txt') AND NOT contains({path}, '/'))"


def is_package_json_sql(path: str) -> str:
    return f"(lower({path}) = 'package.json')"


def manifest_text_sql(content: str) -> str:
    """Text of a manifest with undecodable bytes left out.

    ``make_valid_utf8`` marks such bytes with U+FFFD; marks already in the text are set aside first.
    """
    text = f"CAST({content} AS STRING)"
    null, mark = "decode(unhex('00'), 'utf-8')", r"'�'"
    aside = f"replace(replace({text}, {null}, concat({null}, 'a')), {mark}, concat({null}, 'b'))"
    kept = f"replace(make_valid_utf8({aside}), {mark}, '')"
    restored = f"replace(replace({kept}, concat({null}, 'b'), {mark}), concat({null}, 'a'), {null})"
    return f"IF(is_valid_utf8({text}), {text}, {restored})"


def _requirements_sql(lines: str) -> str:
    """One struct per stripped line of a requirements file."""
    name = f"lower({strip_sql(f'split(l, {quote(NAME_END)}, 2)[0]')})"
    return f"transform({lines}, (l, i) -> named_struct('line', i + 1, 'text', l, 'name', {name}))"


def _last_of_each_sql(entries: str) -> str:
    """Entries of a section, the last one of a repeated key, as JSON readers keep it, in their order.

    Sorted by key, an entry is the last one where the next has another key. Without a repeated key nothing is sorted.
    """
    placed = f"array_sort(transform({entries}, (e, i) -> named_struct('key', e.key, 'at', i, 'value', e.value)))"
    last = f"transform(array({placed}), a -> filter(a, (e, i) -> NOT (get(a, i + 1).key <=> e.key)))[0]"
    in_order = f"array_sort(transform({last}, e -> named_struct('at', e.at, 'key', e.key, 'value', e.value)))"
    kept = f"transform({in_order}, e -> named_struct('key', e.key, 'value', e.value))"
    return f"IF(size(array_distinct(transform({entries}, e -> e.key))) = size({entries}), {entries}, {kept})"


def _section_sql(section: str) -> str:
    """Entries of one section, the last one of each key, without their lines."""
    entry = (
        f"named_struct('section', {quote(section)}, 'key', e.key, 'name', lower(e.key), "
        f"'version', lower({strip_sql("coalesce(e.value, 'none')")}))"
    )
    entries = _last_of_each_sql(f"map_entries(_parsed.{section})")
    return f"coalesce(transform({entries}, e -> {entry}), CAST(array() AS ARRAY<{_ENTRY}>))"


def _line_keys_sql() -> str:
    """The keys that lines begin with, each with its first line (from 1): a quoted text and a colon.

    A line has one such text without a quote inside. Only where a dependency's name holds a quote, the longer ones of
    each line count as well.
    """
    colon = r"(?U)^[\s\x1f]*:"
    short = (
        f"array(IF({regex('s', r'(?U)^"[^"]*"[\s\x1f]*:')}, regexp_extract(s, {quote(r'^"([^"]*)"')}, 1), NULL))"
    )
    # cut at quotes, the text up to a cut is a key if a colon follows there
    every = (
        "IF(startswith(s, '\"'), transform(array(split(s, '\"')), cut -> transform(filter(sequence(3, greatest(size(cut), 3)), "
        f"at -> coalesce({regex('get(cut, at - 1)', colon)}, false)), at -> array_join(slice(cut, 2, at - 2), '\"')))[0], "
        "CAST(array() AS ARRAY<STRING>))"
    )
    quoted = "exists(_entries, e -> contains(e.key, '\"'))"
    listed, simple = (
        f"transform(_stripped, (s, i) -> transform({keys}, k -> named_struct('key', k, 'line', i + 1)))" for keys in (every, short)
    )
    placed = f"array_sort(filter(flatten(IF({quoted}, {listed}, {simple})), x -> x.key IS NOT NULL))"
    return f"transform(array({placed}), a -> filter(a, (x, i) -> i = 0 OR a[greatest(i - 1, 0)].key <> x.key))[0]"


def _entry_lines_sql() -> str:
    """The line of each of ``_entries``, 0 where no line begins with its key, by one sorted merge of both lists.

    A key has at most one line and one entry a section, so its line stands at most that many places before its entries.
    """
    merged = (
        "array_sort(concat(transform(_line_keys, x -> named_struct('key', x.key, 'entry', -1, 'line', x.line)), "
        "transform(_entries, (e, i) -> named_struct('key', e.key, 'entry', i, 'line', 0))))"
    )
    before = ", ".join(
        f"IF(get(a, i - {k}).key = x.key AND get(a, i - {k}).entry = -1, get(a, i - {k}).line, NULL)"
        for k in range(1, len(SECTIONS) + 1)
    )
    found = (
        f"transform(array({merged}), a -> filter(transform(a, (x, i) -> named_struct('entry', x.entry, 'line', "
        f"coalesce({before}, 0))), x -> x.entry >= 0))[0]"
    )
    return f"transform(array_sort({found}), x -> x.line)"


def entry_columns() -> dict[str, str]:
    """``_requirements`` and ``_packages`` and what they need, from ``path`` and ``content`` (null for other files).

    A package manifest has to be one JSON object. Wrapping the text into an array makes text after the object an
    error.
    """
    requirements, package = is_requirements_sql("path"), is_package_json_sql("path")
    parsed = (
        f"from_json(concat('[', _manifest_text, ']'), '{_MANIFEST}', "
        "map('allowSingleQuotes', 'false', 'mode', 'PERMISSIVE'))"
    )
    line = "get(_entry_lines, i)"
    with_line = (
        "transform(_entries, (e, i) -> named_struct('section', e.section, 'key', e.key, 'name', e.name, "
        f"'version', e.version, 'line', CAST({line} AS INT), 'text', IF({line} > 0, get(_stripped, {line} - 1), e.key)))"
    )
    text_of_manifest = f"IF({requirements} OR {package}, {manifest_text_sql('content')}, NULL)"
    return {
        "_manifest_raw": text_of_manifest,
        "_manifest_text": universal_newlines_sql("_manifest_raw"),
        "_stripped": f"transform({split_lines_sql('_manifest_text')}, l -> {strip_sql('l')})",
        "_requirements": f"IF({requirements}, {_requirements_sql('_stripped')}, NULL)",
        "_sections": f"IF({package}, {parsed}, NULL)",
        "_parsed": "IF(size(_sections) = 1, _sections[0], NULL)",
        "_entries": f"IF(_parsed IS NOT NULL, concat({', '.join(map(_section_sql, SECTIONS))}), NULL)",
        "_line_keys": f"IF(size(_entries) > 0, {_line_keys_sql()}, NULL)",
        "_entry_lines": f"IF(size(_entries) > 0, {_entry_lines_sql()}, NULL)",
        "_packages": f"IF(_parsed IS NOT NULL, {with_line}, NULL)",
    }


def _entry_hits(condition: str | None, message: str, heavy: bool) -> str:
    """Findings of one entry ``e``: heavy by name, open by the given condition."""
    text = "e.text"
    note = f"concat('Heavy dependency \\'', e.name, '\\': ', element_at({map_of(HEAVY_DEPENDENCIES)}, e.name))"
    hits = []
    if heavy:
        found = finding_sql("'GC051'", "e.line", "0", text, note)
        hits.append(f"IF({in_list('e.name', [name for name, _ in HEAVY_DEPENDENCIES])}, {found}, NULL)")
    if condition:
        hits.append(f"IF({condition}, {finding_sql("'GC052'", 'e.line', '0', text, message)}, NULL)")
    return f"array({', '.join(hits)})"


def manifest_columns(rules: Sequence[Rule]) -> dict[str, str]:
    """``_manifest`` and what it needs, from ``path`` and ``content``."""
    enabled = {r.id for r in rules} & {"GC051", "GC052"}
    if not enabled:
        return {"_manifest": NO_FINDINGS}
    heavy, loose = "GC051" in enabled, "GC052" in enabled
    unpinned = (
        f"e.text <> '' AND NOT startswith(e.text, '#') AND e.name <> '' AND NOT ({regex('e.text', VERSION_MARK)})"
    )
    opened = f"({in_list('e.version', OPEN_VERSIONS)} OR endswith(e.version, '.x'))"
    requirement = _entry_hits(
        unpinned if loose else None, "concat('Dependency \\'', e.name, '\\' without a version')", heavy
    )
    package = _entry_hits(
        opened if loose else None, "concat('Dependency \\'', e.name, '\\' with open version ', e.version)", heavy
    )
    parts = [
        f"coalesce({keep_hits_sql(f'flatten(transform({column}, e -> {hits}))')}, {NO_FINDINGS})"
        for column, hits in (("_requirements", requirement), ("_packages", package))
    ]
    return {**entry_columns(), "_manifest": concat_sql(parts)}


def requirement_entries(files: DataFrame) -> DataFrame:
    """One row per line of every root ``requirements*.txt``."""
    rows = with_layers(files.filter(is_requirements_sql("path")), entry_columns()).select(
        "repo_id", "path", F.explode_outer("_requirements").alias("e")
    )
    return rows.filter("e IS NOT NULL").select("repo_id", "path", "e.line", "e.name", "e.text")


def package_entries(files: DataFrame) -> DataFrame:
    """One row per dependency of every root ``package.json``, with the line it is declared on."""
    rows = with_layers(files.filter(is_package_json_sql("path")), entry_columns()).select(
        "repo_id", "path", F.explode_outer("_packages").alias("e")
    )
    return rows.filter("e IS NOT NULL").select(
        "repo_id", "path", "e.section", "e.key", "e.name", "e.version", "e.line", "e.text"
    )
