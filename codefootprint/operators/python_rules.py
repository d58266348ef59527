"""The rules on Python syntax facts, as column expressions over the nodes of one file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column

from ..catalog.rules import Rule
from ..functions.sqltext import in_list, map_of, quote
from ..functions.text import strip_sql
from .finding import NO_FINDINGS, finding_sql
from .pyfacts import syntax_facts

# Names the rules look for.
NETWORK_MODULES = ("requests", "httpx", "urllib", "urllib2", "aiohttp", "http")
NETWORK_METHODS = ("get", "post", "put", "delete", "patch", "head", "request", "urlopen")
QUERY_METHODS = (
    "execute", "executemany", "query", "filter", "filter_by", "get", "first", "all", "fetchone", "fetchall", "find",
    "find_one", "aggregate",
)
QUERY_OWNERS = ("objects", "session", "cursor", "db", "query")
DRIVER_METHODS = ("execute", "executemany", "fetchone", "fetchall")
RE_METHODS = ("compile", "search", "match", "fullmatch", "sub", "subn", "findall", "finditer", "split")
CACHE_DECORATORS = ("lru_cache", "cache", "cached", "cached_property", "memoize")
REDUCERS = ("sum", "any", "all", "min", "max")
LOOP_KINDS = ("For", "AsyncFor", "While")
FUNCTION_KINDS = ("FunctionDef", "AsyncFunctionDef")


_IN_LOOP = "n.loop_depth > 0"
_NETWORK = (
    f"(({in_list('n.call_root', NETWORK_MODULES)} AND {in_list('n.call_attr', NETWORK_METHODS)}) "
    "OR n.call_attr = 'urlopen')"
)
_QUERY = (
    f"({in_list('n.call_attr', QUERY_METHODS)} AND ({in_list('n.call_root', QUERY_OWNERS)} "
    f"OR (n.call_root = '' AND {in_list('n.call_attr', DRIVER_METHODS)})))"
)
_CACHED = f"arrays_overlap(n.decorators, array({', '.join(map(quote, CACHE_DECORATORS))}))"
_CALL = ("Call",)

# Rule id -> node kinds it looks at and its condition on a node ``n``.
CONDITIONS: dict[str, tuple[tuple[str, ...], str]] = {
    "GC001": (LOOP_KINDS, _IN_LOOP),
    "GC002": (("AugAssign",), f"{_IN_LOOP} AND n.is_add AND n.string_like"),
    "GC003": (("While",), "n.const_true AND n.sleeps_below > 0"),
    "GC004": (_CALL, f"{_IN_LOOP} AND n.call_root = 're' AND {in_list('n.call_attr', RE_METHODS)}"),
    "GC005": (_CALL, "n.call_root = 'time' AND n.call_attr = 'sleep' AND n.async_scope"),
    "GC007": (_CALL, f"{_IN_LOOP} AND ((n.func_is_name AND n.call_attr = 'sorted') OR n.call_attr = 'sort')"),
    "GC008": (("Compare",), f"{_IN_LOOP} AND n.in_literal_seq"),
    "GC009": (FUNCTION_KINDS, f"NOT {_CACHED} AND n.self_calls >= 2"),
    "GC011": (_CALL, "n.func_is_name AND n.call_attr = 'open' AND n.field <> 'context_expr'"),
    "GC012": (_CALL, "n.arg0_kind = 'ListComp' AND ((n.func_is_name AND "
                     f"{in_list('n.call_attr', REDUCERS)}) OR n.call_attr = 'join')"),
    "GC013": (_CALL, f"{_IN_LOOP} AND n.call_attr = 'deepcopy'"),
    "GC020": (_CALL, f"{_IN_LOOP} AND {_NETWORK}"),
    "GC021": (_CALL, f"{_IN_LOOP} AND NOT {_NETWORK} AND {_QUERY}"),
}
PYTHON_RULE_IDS = tuple(CONDITIONS)


def _fired_sql(enabled: set[str]) -> str:
    """Ids of the rules a node ``n`` breaks. Conditions are grouped by node kind so each node meets only its own."""
    groups: dict[tuple[str, ...], list[str]] = {}
    for rule_id, (kinds, condition) in CONDITIONS.items():
        if rule_id in enabled:
            groups.setdefault(kinds, []).append(f"IF({condition}, {quote(rule_id)}, NULL)")
    none = "CAST(array() AS ARRAY<STRING>)"
    parts = [
        f"IF({in_list('n.kind', kinds)}, array_compact(array({', '.join(ids)})), {none})"
        for kinds, ids in groups.items()
    ]
    return f"concat({', '.join(parts)})"


def _needed(enabled: Iterable[str]) -> tuple[set[str], set[str]]:
    """Node kinds and fields that the conditions and the report of some rules read."""
    conditions = [CONDITIONS[rule_id] for rule_id in enabled]
    kinds = {kind for own, _ in conditions for kind in own}
    fields = {"kind", "line", "col"}.union(*(re.findall(r"\bn\.(\w+)", text) for _, text in conditions))
    if "Call" in kinds:
        fields |= {"call_root", "call_attr"}
    if kinds & set(FUNCTION_KINDS):
        fields.add("name")
    return kinds, fields


def _report_sql(names: dict[str, str], fields: set[str]) -> str:
    subject = "''"
    if "name" in fields:
        subject = "IF(n.name IS NOT NULL, concat(': ', n.name), '')"
    if "call_root" in fields:
        subject = (
            "IF(n.kind = 'Call', concat(': ', IF(n.call_root <> '', concat(n.call_root, '.'), ''), n.call_attr), "
            f"{subject})"
        )
    message = f"concat(element_at({map_of(names.items())}, rule_id), {subject})"
    found = finding_sql("rule_id", "n.line", "n.col", strip_sql("coalesce(get(lines, n.line - 1), '')"), message)
    hits = f"flatten(transform(_facts.nodes, n -> transform({_fired_sql(set(names))}, rule_id -> {found})))"
    # The outer transform gives the lines a name: a column read once is replaced by its expression, which inside the inner one
    # would cut the text anew for every node.
    return f"transform(array(_lines), lines -> {hits})[0]"


def python_columns(rules: Sequence[Rule]) -> dict[str, str | Column]:
    """``_python``, ``_error`` and what they need, from ``language``, ``_text`` and ``_lines``. Without a rule the texts
    are still parsed for their errors, but no node comes back."""
    names = {r.id: r.name for r in rules if r.id in CONDITIONS}
    kinds, fields = _needed(names)
    return {
        "_facts": syntax_facts(kinds, fields),
        "_python": f"IF(size(_facts.nodes) > 0, {_report_sql(names, fields)}, {NO_FINDINGS})" if names else NO_FINDINGS,
        "_error": "concat('Python syntax error (', _facts.error, ')')",
    }
