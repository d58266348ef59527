"""Small helpers to write Spark SQL expressions.

Detectors are large expressions over one row. Written as SQL text they reach the JVM in one call each; built from
Column objects the same plan takes tens of thousands of calls between Python and the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable


def quote(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def in_list(expression: str, values: Iterable[str]) -> str:
    return f"{expression} IN ({', '.join(map(quote, values))})"


def any_of(conditions: Iterable[str]) -> str:
    return "(" + (" OR ".join(conditions) or "false") + ")"


def contains_any(expression: str, needles: Iterable[str]) -> str:
    return any_of(f"contains({expression}, {quote(n)})" for n in needles)


def map_of(pairs: Iterable[tuple[str, str]]) -> str:
    return "map(" + ", ".join(f"{quote(k)}, {quote(v)}" for k, v in pairs) + ")"


def regex(expression: str, pattern: str) -> str:
    return f"{expression} RLIKE {quote(pattern)}"
