"""Line patterns on comment-free source.

All rules share one dictionary of literals: each rule names some of which every line it hits holds one (its hints, or what its
pattern requires). A text is searched once for any of them; only then it is scrubbed and cut into lines, each line is searched once
for the literals in it, and a rule looks only at the lines with one of its own. So the cost of a text grows with its size
and its candidates, not with the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from ..catalog.rules import Rule
from ..functions.literals import any_literal, first_characters, required_literals
from ..functions.scrub import strip_comments_sql
from ..functions.sqltext import any_of, in_list, quote, regex
from ..functions.text import code_point_column_sql, java_regex, skipping_column_sql, split_lines_sql, strip_sql
from .finding import NO_FINDINGS, concat_sql, finding_sql, keep_hits_sql

Enabled = Callable[[Rule], str]


def regex_rules(rules: Sequence[Rule]) -> list[Rule]:
    return [r for r in rules if r.detector == "regex" and r.pattern]


def literals_of(rule: Rule) -> tuple[str, ...]:
    """Lower-cased ASCII literals of which every line the rule hits holds one; none if the rule has to see every line."""
    if not rule.ignore_case and re.compile(rule.pattern).flags & re.IGNORECASE:
        return ()  # folds letters beyond ASCII too, which the catalogue doesn't know of
    words = tuple(h.lower() for h in rule.hints) or required_literals(rule.pattern)
    return words if all(w and w.isascii() for w in words) else ()


def _covers(rule: Rule) -> str:
    return in_list("language", rule.languages) if rule.languages else "language IS NOT NULL"


def _words_sql(words: Sequence[str]) -> str:
    return f"array({', '.join(map(quote, words))})"


def _rule_hits(rule: Rule, dictionary: Sequence[str], enabled: Enabled | None) -> str:
    """The rule's findings in ``_hot``. Beyond ASCII, letters fold in ways a search in the lower-cased text does not see, so
    there a rule that ignores case sees all lines."""
    pattern = rule.linear or rule.pattern
    hit = regex("h.line", java_regex(pattern, rule.ignore_case))
    column = skipping_column_sql if rule.linear else code_point_column_sql
    admitted = _covers(rule) if enabled is None else f"{_covers(rule)} AND {enabled(rule)}"
    words = literals_of(rule)
    if words:
        # a line tells the longest literal at each place, which stands for those it begins with
        own = _words_sql([w for w in dictionary if w.startswith(words)])
        known = "" if not rule.ignore_case else "NOT _ascii OR "
        admitted += f" AND ({known}arrays_overlap(_literals, {own}))"
        hit = f"({known}arrays_overlap(h.found, {own})) AND {hit}"
    if rule.require_absent:
        hit += f" AND NOT {regex('h.line', java_regex(rule.require_absent, rule.ignore_case))}"
    found = finding_sql(
        quote(rule.id), "h.i + 1", column("h.line", pattern, rule.ignore_case),
        strip_sql("h.raw"), quote(rule.name),
    )
    return f"IF({admitted}, {keep_hits_sql(f'transform(_hot, h -> IF({hit}, {found}, NULL))')}, {NO_FINDINGS})"


def regex_columns(rules: Sequence[Rule], enabled: Enabled | None = None) -> dict[str, str]:
    """``_regex`` and what it needs, from ``language``, ``_text``, ``_plain`` and ``_lines``. ``enabled`` gives the condition under
    which a rule holds for a row, true for all where there is none."""
    active = regex_rules(rules)
    if not active:
        return {"_regex": NO_FINDINGS}
    words = [literals_of(rule) for rule in active]
    dictionary = sorted({w for own in words for w in own})
    covered = any_of(sorted({_covers(rule) for rule in active}))
    folding = any(rule.ignore_case for rule in active)
    worth, found = "true", "CAST(array() AS ARRAY<STRING>)"
    if dictionary:
        found = f"array_distinct(regexp_extract_all(lower(line), {quote(f'(?={first_characters(dictionary)})(?=({any_literal(dictionary)}))')}, 1))"
    if all(words):
        worth = f"({'NOT _ascii OR ' if folding else ''}{regex('_lower', any_literal(dictionary))})"
    kept = "true" if not all(words) else f"{'NOT x.ascii OR ' if folding else ''}size(h.found) > 0"
    # The outer transforms give columns a name: one that is read once is replaced by its expression, which in the inner
    # one would run for every line.
    cut = f"(line, i) -> named_struct('i', i, 'line', line, 'raw', coalesce(get(raw, i), line), 'found', {found})"
    lines = (
        f"transform(array(named_struct('raw', _lines, 'ascii', _ascii)), x -> filter(transform(array(x.raw), raw -> "
        f"transform(_scrubbed, {cut}))[0], h -> {kept}))[0]"
    )
    return {
        "_lower": "IF(language IS NOT NULL, lower(_text), NULL)",
        "_ascii": "octet_length(_text) = char_length(_text)",
        "_worth": f"coalesce({covered} AND {worth}, false)",
        "_clean": f"IF(_worth, {strip_comments_sql('_text', 'language')}, NULL)",
        "_scrubbed": f"IF(_worth, {split_lines_sql('_clean', '_plain')}, NULL)",
        "_hot": f"IF(_worth, {lines}, NULL)",
        "_literals": "IF(_worth, array_distinct(flatten(transform(_hot, h -> h.found))), NULL)",
        "_regex": f"IF(size(_hot) > 0, {concat_sql([_rule_hits(r, dictionary, enabled) for r in active])}, {NO_FINDINGS})",
    }
