"""Rules held as rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import translate_regex
from .rules import DEFAULT_RULES, Rule

#: Catalogues are compiled into the plan, so their size is bounded.
MAX_RULES = 5_000

_OPTIONAL = {
    "detector": "'regex'", "languages": "CAST(array() AS ARRAY<STRING>)", "pattern": "CAST(NULL AS STRING)",
    "require_absent": "CAST(NULL AS STRING)", "ignore_case": "false", "linear": "CAST(NULL AS STRING)",
    "hints": "CAST(array() AS ARRAY<STRING>)", "description": "''", "remediation": "''",
}


def rules_from_table(rows: DataFrame, max_rules: int = MAX_RULES) -> tuple[Rule, ...]:
    """The rules of a table, in the order of their ids: ``rule_id, name, category, severity`` and, where they are there,
    the other fields of :class:`Rule`; nulls stand for defaults.

    Raises ``ValueError`` for a table that can't be used, before any scan: repeated or null ids, a severity below 1, a wrong
    pattern, a line rule without one, or a detector other than ``regex`` whose id the built-in rules don't have.
    """
    columns = [F.col(c) for c in ("rule_id", "name", "category", "severity")]
    columns += [
        F.coalesce(F.col(c), F.expr(default)).alias(c) if c in rows.columns else F.expr(default).alias(c)
        for c, default in _OPTIONAL.items()
    ]
    found = rows.select(*columns).orderBy("rule_id").limit(max_rules + 1).collect()
    if len(found) > max_rules:
        raise ValueError(f"more than {max_rules} rules; a larger catalogue does not fit one plan")
    built_in = {r.id: r.detector for r in DEFAULT_RULES if r.detector != "regex"}
    rules, seen = [], set()
    for r in found:
        if r.rule_id is None or r.rule_id in seen:
            raise ValueError(f"rule id {r.rule_id!r} is null or stands there twice")
        seen.add(r.rule_id)
        if r.name is None or r.category is None or r.severity is None or r.severity < 1:
            raise ValueError(f"rule {r.rule_id!r} needs a name, a category and a severity of 1 or more")
        if r.detector == "regex":
            if not r.pattern:
                raise ValueError(f"line rule {r.rule_id!r} has no pattern")
            for pattern in filter(None, (r.pattern, r.require_absent)):
                try:
                    translate_regex(pattern)
                except ValueError as exc:
                    raise ValueError(f"rule {r.rule_id!r}: {exc}") from exc
        elif built_in.get(r.rule_id) != r.detector:
            raise ValueError(f"rule {r.rule_id!r}: no detector {r.detector!r} of that id")
        rules.append(Rule(
            r.rule_id, r.name, r.category, int(r.severity), r.detector, tuple(r.languages), r.pattern, r.require_absent,
            bool(r.ignore_case), r.linear, tuple(r.hints), r.description, r.remediation,
        ))
    return tuple(rules)
