"""Repositories with rules and weights of their own, in one plan.

A profile names the rules that hold for a repository. It travels as a bitmap over the compiled catalogue, so a file row
carries a few numbers and no file meets a rule row. A small profile table is broadcast to the files, and detectors skip what
is off; a large one would move the texts, so there the scan runs with all rules and the findings, which are narrow, meet the
bitmaps afterwards. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.rules import DEFAULT_RULES, Rule
from ..functions.sqltext import quote
from ..functions.values import DEFAULT_K
from .scan import ENABLED, keep_enabled, scan_files
from .scoring import finish_scores, scan_totals

#: Profiles that are broadcast at most; more are joined to the findings.
BROADCAST_PROFILES = 200_000


def profile_bits(profiles: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES) -> DataFrame:
    """``repo_id`` and its bitmap, 64 rules a number. Null ``rule_ids`` are all rules, unknown ids are passed by; several rows of
    a repository count together."""
    ids = [r.id for r in rules]
    words = []
    for start in range(0, max(len(ids), 1), 64):
        part = ids[start : start + 64]
        bits = ", ".join(f"{quote(i)}, shiftleft(1L, {n})" for n, i in enumerate(part))
        own = f"aggregate(rule_ids, 0L, (all, id) -> all | coalesce(try_element_at(map({bits}), id), 0L))" if part else "0L"
        words.append(f"IF(rule_ids IS NULL, -1L, {own})")
    rows = profiles.filter("repo_id IS NOT NULL").selectExpr("repo_id", *(f"{w} AS w{n}" for n, w in enumerate(words)))
    return rows.groupBy("repo_id").agg(F.array(*(F.expr(f"bit_or(w{n})") for n in range(len(words)))).alias(ENABLED))


def scan_profiles(
    files: DataFrame, profiles: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES,
    broadcast_profiles: int = BROADCAST_PROFILES, **options,
) -> DataFrame:
    """The scan of ``scan_files`` with the findings of each repository's own rules.

    ``profiles`` has ``repo_id`` and ``rule_ids`` (an array; null: all rules). A repository without a profile has all rules.
    """
    rules = tuple(rules)
    bits = profile_bits(profiles, rules)
    if profiles.limit(broadcast_profiles + 1).count() <= broadcast_profiles:
        return scan_files(files.join(F.broadcast(bits), "repo_id", "left"), rules, **options)
    scanned = scan_files(files, rules, **options)
    joined = scanned.join(bits, "repo_id", "left").withColumn("findings", F.expr(keep_enabled("findings", rules)))
    return joined.select(*scanned.columns)


def profile_scores(
    scanned: DataFrame, profiles: DataFrame, rules: Iterable[Rule] = DEFAULT_RULES, k: float | Column = DEFAULT_K
) -> DataFrame:
    """Scores with each repository's own weight: column ``k`` of its profile (the largest of several), else ``k``."""
    weights = profiles.groupBy("repo_id").agg(F.max("k").cast("double").alias("_k"))
    totals = scan_totals(scanned, rules).join(weights, "repo_id", "left")
    own = F.coalesce("_k", F.lit(float(k)) if not isinstance(k, Column) else k)
    return finish_scores(totals, own).drop("_k")
