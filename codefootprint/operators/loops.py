"""Nested loops in brace languages, as a fold over the few tokens that matter."""

from __future__ import annotations

from ..catalog.rules import C_LIKE
from ..functions.scrub import mask_code_sql
from ..functions.sqltext import in_list, quote, regex
from ..functions.text import strip_sql
from .finding import NO_FINDINGS, finding_sql

_TOKENS = r"(?U)\b(?:for|while|foreach)\b|[(){};]|\n+"
_TWO_LOOPS = r"(?s)(?:for|while).*?(?:for|while)"


def nested_loop_lines_sql(masked: str) -> str:
    """Lines (1-based) of every ``{`` that opens a loop body while a loop body is open.

    The open blocks are a string of ``1`` (loop body) and ``0``. A loop keyword waits for its ``{``; it is
    forgotten at a ``;`` outside parentheses, and a block inside open parentheses is never a loop body.
    """
    body = "(s.waiting AND s.depth = 0)"
    start = "named_struct('blocks', '', 'waiting', false, 'depth', 0, 'line', 1, 'found', CAST(array() AS ARRAY<INT>))"
    step = (
        "named_struct("
        f"'blocks', CASE t WHEN '{{' THEN concat(s.blocks, IF({body}, '1', '0')) "
        "WHEN '}' THEN left(s.blocks, length(s.blocks) - 1) ELSE s.blocks END, "
        "'waiting', CASE WHEN startswith(t, 'f') OR startswith(t, 'w') THEN true "
        "WHEN t = '{' OR (t = ';' AND s.depth = 0) THEN false ELSE s.waiting END, "
        "'depth', CASE t WHEN '(' THEN s.depth + 1 WHEN ')' THEN greatest(s.depth - 1, 0) ELSE s.depth END, "
        "'line', IF(startswith(t, '\\n'), s.line + length(t), s.line), "
        f"'found', IF(t = '{{' AND {body} AND contains(s.blocks, '1'), concat(s.found, array(s.line)), s.found))"
    )
    tokens = f"regexp_extract_all({masked}, {quote(_TOKENS)}, 0)"
    return f"aggregate({tokens}, {start}, (s, t) -> {step}, s -> s.found)"


def loop_columns(enabled: bool = True) -> dict[str, str]:
    """``_loops`` and what it needs, from ``language``, ``_text`` and ``_lines``. Texts with fewer than two loop
    keywords cannot nest loops and are passed by."""
    if not enabled:
        return {"_loops": NO_FINDINGS}
    worth = f"{in_list('language', C_LIKE)} AND {regex('_text', _TWO_LOOPS)}"
    found = finding_sql(
        "'GC001'", "at", "0", strip_sql("coalesce(get(lines, at - 1), '')"), "'Nested loops'"
    )
    return {
        "_nested": f"IF({worth}, {nested_loop_lines_sql(mask_code_sql('_text', 'language'))}, NULL)",
        # the outer transform keeps the lines from being cut anew for every finding
        "_loops": f"coalesce(transform(array(_lines), lines -> transform(_nested, at -> {found}))[0], {NO_FINDINGS})",
    }
