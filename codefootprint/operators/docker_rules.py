"""Dockerfile instructions, on raw lines (comments and continuations are not interpreted)."""

from __future__ import annotations

from collections.abc import Sequence

from ..catalog.rules import Rule
from ..functions.paths import base_name_sql
from ..functions.sqltext import in_list, quote, regex
from ..functions.text import strip_sql
from .finding import NO_FINDINGS, concat_sql, finding_sql, keep_hits_sql

# Image names and patterns of the Dockerfile rules.
FULL_IMAGES = (
    "node", "python", "golang", "go", "openjdk", "ruby", "php", "debian", "ubuntu", "maven", "gradle", "rust",
)
TOOLCHAIN_IMAGE = r"(?iU)\b(node|python|golang|maven|gradle|openjdk|rust|ruby)\b"
STAGE_ALIAS = r"(?iU)\bAS\b"
PIP_INSTALL = r"(?U)\bpip3?[\s\x1f]+install\b"
APT_INSTALL = r"(?U)\bapt(-get)?[\s\x1f]+install\b"
FROM_IMAGE = r"(?U)^\S+[\s\x1f]+(\S+)"
ARCHIVE = r"(?iU)\.(tar|tgz|gz|bz2|xz|zip)\b"

DOCKER_RULE_IDS = ("GC080", "GC081", "GC082", "GC083", "GC084")


def _instruction(line: str, word: str) -> str:
    return f"upper(left({line}, {len(word) + 1})) = '{word} '"


def _found(rule_id: str, line: str, text: str, message: str) -> str:
    return finding_sql(quote(rule_id), line, "0", text, quote(message))


def _from_rules() -> dict[str, str]:
    """Findings on the FROM lines: ``f`` has the line, its text, the image and the parts of the image's last path part."""
    name, tag = "lower(f.parts[0])", "lower(coalesce(get(f.parts, 1), ''))"
    floating = "contains(f.image, ':latest') OR size(f.parts) = 1"
    full = f"{in_list(name, FULL_IMAGES)} AND NOT contains({tag}, 'slim') AND NOT contains({tag}, 'alpine')"
    return {
        rule_id: f"transform(filter(_froms, f -> {condition}), f -> {_found(rule_id, 'f.line', 'f.text', message)})"
        for rule_id, condition, message in (
            ("GC080", floating, "Base image without a fixed tag"), ("GC083", full, "Full base image"),
        )
    }


def _line_rules() -> dict[str, str]:
    """Finding or null for a stripped line ``l`` with index ``i``. The cheap test comes first."""
    run, add = (_instruction("l", word) for word in ("RUN", "ADD"))
    pip = f"{regex('l', PIP_INSTALL)} AND NOT contains(l, '--no-cache-dir')"
    apt = f"{regex('l', APT_INSTALL)} AND NOT contains(l, '--no-install-recommends')"
    cached = _found("GC082", "i + 1", "l", "pip install without --no-cache-dir")
    extra = _found("GC082", "i + 1", "l", "apt install without --no-install-recommends")
    copied = _found("GC084", "i + 1", "l", "ADD used for local files")
    return {
        "GC082": f"WHEN contains(l, 'install') AND {run} THEN IF({pip}, {cached}, IF({apt}, {extra}, NULL))",
        "GC084": f"WHEN {add} AND NOT contains(lower(l), 'http') AND NOT {regex('l', ARCHIVE)} THEN {copied}",
    }


def _single_stage() -> str:
    """One finding on the first FROM when no stage is named and some FROM mentions a tool chain image."""
    found = _found("GC081", "_froms[0].line", "_froms[0].text", "Single stage build on a tool chain image")
    condition = (
        f"NOT exists(_froms, f -> {regex('f.text', STAGE_ALIAS)}) AND "
        f"exists(_froms, f -> {regex('f.text', TOOLCHAIN_IMAGE)})"
    )
    return f"IF({condition}, array({found}), {NO_FINDINGS})"


def docker_columns(rules: Sequence[Rule]) -> dict[str, str]:
    """``_docker`` and what it needs, from ``language`` and ``_lines``."""
    enabled = {r.id for r in rules} & set(DOCKER_RULE_IDS)
    if not enabled:
        return {"_docker": NO_FINDINGS}
    image = f"regexp_extract(l, {quote(FROM_IMAGE)}, 1)"
    froms = keep_hits_sql(
        f"transform(_steps, (l, i) -> IF({_instruction('l', 'FROM')}, "
        f"named_struct('line', i + 1, 'text', l, 'image', {image}), NULL))"
    )
    with_base = f"transform({froms}, f -> named_struct('line', f.line, 'text', f.text, 'image', f.image, 'parts', split({base_name_sql('f.image')}, ':')))"
    parts = [found for rule_id, found in _from_rules().items() if rule_id in enabled]
    cases = [case for rule_id, case in _line_rules().items() if rule_id in enabled]
    if cases:
        parts.append(keep_hits_sql(f"transform(_steps, (l, i) -> CASE {' '.join(cases)} END)"))
    if "GC081" in enabled:
        parts.append(_single_stage())
    return {
        "_steps": f"IF(language = 'dockerfile', transform(_lines, l -> {strip_sql('l')}), NULL)",
        "_froms": with_base,
        "_docker": f"IF(_steps IS NOT NULL, {concat_sql(parts)}, {NO_FINDINGS})",
    }
