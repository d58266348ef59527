"""Quality rules whose cutoffs are chosen on labelled holdouts under a guaranteed bound on false rejection.

A rule rejects a text whose measure is above a cutoff. For each stratum (language) and rule, cutoffs are tested from the
loosest to the tightest on the labelled good texts of the stratum: a cutoff passes if the exact (Clopper-Pearson) upper
bound of the share of good texts that it rejects is within the rule's part of the allowed risk; the first failure ends the
sequence, so no correction is due along it. Between rules and strata the error level is split (Bonferroni), and the
allowed risk is split between rules, so with probability 1 - ERROR every stratum loses at most RISK of its good texts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store
from codefootprint.llm.words import word_hashes

#: Good texts of a stratum that all rules together may reject, and the probability that the guarantee fails.
RISK = 0.04
ERROR = 0.05
#: Languages with a stratum of their own (the most frequent labelled ones); all others share one.
MAX_STRATA = 64
#: Cutoffs from the loosest to the tightest.
GRID = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.075, 0.05, 0.025, 0.01)
SYMBOLS = b"#*$%&|<>"
WINDOW = 8

#: The rules' measures, each between 0 and 1.
MEASURES = {
    "symbol_share": "least(1D, n_symbols / greatest(n_words, 1))",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "same_word_share": "1D - n_distinct_words / greatest(n_words, 1)",
}


def measure_text(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_distinct_words of a whole text.

    Null is an empty text. Lines count only with a word in them; upper-case letters are A to Z.
    """
    if not text:
        return (0,) * 8
    data = text.encode("utf-8", "replace")
    hashes, _, _ = word_hashes(data)
    n = len(hashes)
    word_chars = len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    lines = [line for line in data.split(b"\n") if line.strip()]
    repeated, distinct = 0, 0
    if n:
        ids = np.unique(hashes, return_inverse=True)[1].astype(np.uint64)
        distinct = int(ids.max()) + 1
        if n > WINDOW:
            with np.errstate(over="ignore"):
                key = np.zeros(n - WINDOW + 1, dtype=np.uint64)
                for k in range(WINDOW):
                    key = key * np.uint64(0x9E3779B97F4A7C15) + ids[k : n - WINDOW + 1 + k] + np.uint64(1)
            order = np.argsort(key, kind="stable")
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(key), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            borders = np.zeros(n + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            np.add.at(borders, at, 1)
            np.add.at(borders, at + WINDOW, -1)
            repeated = int(np.count_nonzero(np.cumsum(borders[:-1])))
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, distinct


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words")


def with_measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts of ``measure_text`` and the shares of MEASURES."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def measure(texts):
        import pandas as pd

        return pd.DataFrame([measure_text(t) for t in texts], columns=COUNTS, dtype="int64")

    counted = docs.select("doc_id", "lang", measure("text").alias("m")).select("doc_id", "lang", "m.*")
    return counted.selectExpr("*", *(f"{sql} AS {name}" for name, sql in MEASURES.items()))


def upper_bound(rejected: int, n: int, error: float) -> float:
    """Exact upper confidence bound of a share of which ``rejected`` of ``n`` were seen; 1 if nothing was seen."""
    if n == 0 or rejected >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]

    def at_most(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        terms = [c + k * a + (n - k) * b for k, c in enumerate(logs)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    low, high = rejected / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and at_most(mid) > error else (low, mid)
    return high


def choose_cutoffs(passed: dict[tuple[str, str, int], int], good: dict[str, int], risk: float = RISK, error: float = ERROR) -> dict[tuple[str, str], float]:
    """Tightest cutoff that the sequence of tests accepts, by stratum and rule; none where not even the loosest passes.

    passed: good texts by stratum, rule and number of GRID's cutoffs that they exceed.
    """
    level = error / max(1, len(MEASURES) * len(good))
    share = risk / len(MEASURES)
    found = {}
    for stratum, n in good.items():
        for rule in MEASURES:
            for i, cutoff in enumerate(GRID):
                rejected = sum(passed.get((stratum, rule, k), 0) for k in range(len(GRID) - i, len(GRID) + 1))
                # most failures show at the plain share already
                if rejected > share * n or upper_bound(rejected, n, level) > share:
                    break
                found[stratum, rule] = cutoff
    return found


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the rules' verdict columns.

    docs: doc_id, text, lang; labels: doc_id, quality (1 is good). base_failed: fewer than 20 words, or more than 30 % of
    the words in repeated windows. kept: neither base_failed nor rejected by a rule. Null texts count as empty, a null
    language belongs to the shared stratum, an id that is labelled more than once is good only if all its labels say so.
    Without enough good labels a stratum has no cutoffs and the rules reject nothing. Repeated rows are judged alike.
    The driver gets one count per stratum, rule and cutoff; the cutoffs are part of the plan, MAX_STRATA at most.
    """
    store = Store(docs.sparkSession, "quality")
    measured = store.put(with_measures(docs), "measured")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    good = measured.where("n_words > 0").join(known.where("quality = 1"), "doc_id", "left_semi")
    named = [r[0] for r in good.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_STRATA).collect()]
    stratum = F.when(F.col("lang").isin(named), F.concat(F.lit("lang:"), "lang")).otherwise(F.lit("other")) if named else F.lit("other")
    exceeded = lambda m: F.expr(" + ".join(f"int({m} > {c}D)" for c in GRID))
    counted = (
        good.select(stratum.alias("stratum"), F.explode(F.array(*(F.struct(F.lit(m).alias("rule"), exceeded(m).alias("k")) for m in MEASURES))).alias("t"))
        .groupBy("stratum", "t.rule", "t.k").count().collect()
    )
    passed = {(r.stratum, r.rule, r.k): r["count"] for r in counted}
    sizes: dict[str, int] = {}
    for (s, rule, _), n in passed.items():
        if rule == next(iter(MEASURES)):
            sizes[s] = sizes.get(s, 0) + n
    cutoffs = choose_cutoffs(passed, sizes, risk, error)

    def rejected(rule: str) -> Column:
        out = F.lit(False)
        for (s, r), cutoff in cutoffs.items():
            if r == rule:
                out = out | ((F.col("stratum") == s) & (F.col(rule) > cutoff))
        return out

    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = measured.withColumn("stratum", stratum).withColumn("base_failed", base)
    rules = {f"rejected_{m}": rejected(m) for m in MEASURES}
    judged = judged.withColumns(rules)
    kept = ~F.col("base_failed")
    for name in rules:
        kept = kept & ~F.col(name)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "stratum", *rules
    )
