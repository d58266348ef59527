"""The finding struct every detector returns, as SQL text."""

from __future__ import annotations

from collections.abc import Sequence

FINDING = (
    "STRUCT<rule_id: STRING, line: INT, column: INT, snippet: STRING, message: STRING, extra: MAP<STRING, STRING>>"
)
NO_FINDINGS = f"CAST(array() AS ARRAY<{FINDING}>)"
_NO_EXTRA = "CAST(map() AS MAP<STRING, STRING>)"


def finding_sql(
    rule_id: str, line: str, column: str, snippet: str, message: str, extra: str = _NO_EXTRA
) -> str:
    """A finding from SQL expressions."""
    return (
        f"named_struct('rule_id', {rule_id}, 'line', CAST({line} AS INT), 'column', CAST({column} AS INT), "
        f"'snippet', {snippet}, 'message', {message}, 'extra', {extra})"
    )


def keep_hits_sql(candidates: str) -> str:
    return f"filter({candidates}, hit -> hit IS NOT NULL)"


def concat_sql(arrays: Sequence[str]) -> str:
    return f"concat({', '.join(arrays)})" if arrays else NO_FINDINGS
