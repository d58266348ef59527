"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The statistics (lengths, character classes, repetition, entropy) are computed in numpy, a bounded segment of a batch at a
time. Trees of one depth are grown level by level on histograms of binned statistics, and kept as arrays: a node's children
are at 2i+1 and 2i+2, so all trees are walked at once, one array step per level.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.words import IS_SPACE, Rolling, mixed, word_bounds

TREES = 80
DEPTH = 4
BINS = 64
LEARNING_RATE = 0.15
PENALTY = 1.0
#: Bound of the training sample: slices of each class by digest, and rows of a slice.
SLICES = 16
ROWS_PER_SLICE = 1000
PREDICT_AT = 0.3
#: Bytes whose words are found at a time.
SEGMENT = 1 << 22

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789",
    "symbol": b"#*$%&|<>", "stop": b".!?", "pause": b",;:", "bracket": b"()[]{}", "quote": b"\"'`", "link": b"/\\@_=+~^",
    "dash": b"-", "vowel": b"aeiouAEIOU", "space": b" \t", "line": b"\n",
}
_OF_CLASS = np.zeros((256, len(_CLASSES)), dtype=np.float64)
for _k, _members in enumerate(_CLASSES.values()):
    _OF_CLASS[list(_members), _k] = 1
FEATURES = (
    "log_bytes", "log_words", "log_lines", "words_a_line", "other_share", "control_share", *(f"{c}_share" for c in _CLASSES),
    "symbols_a_word", "stops_a_word", "entropy", "word_length", "word_length_spread", "longest_word", "short_words",
    "distinct_words", "commonest_word", "same_as_before", "distinct_pairs", "distinct_triples", "repeated_lines", "odd_words",
    "caps_a_word",
)


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about SEGMENT bytes that end at a space, or later if there is none."""
    start = 0
    while start < len(data):
        end = min(start + SEGMENT, len(data))
        while end < len(data) and not IS_SPACE[data[end - 1]]:
            ahead = np.flatnonzero(IS_SPACE[data[end : end + SEGMENT]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(end + SEGMENT, len(data))
        yield start, end
        start = end


def _distinct(doc: np.ndarray, key: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document: how many different keys, and how often its commonest stands there."""
    order = np.lexsort((key, doc))
    d, k = doc[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])])) if len(d) else np.zeros(0, int)
    runs = np.diff(np.append(first, len(d)))
    most = np.zeros(docs)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=docs).astype(np.float64), most


def statistics_of(texts: Sequence[str | None]) -> np.ndarray:
    """One row of FEATURES per text; a null text counts as an empty one, whose statistics are all 0."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    docs = len(raw)
    sizes = np.array([len(b) for b in raw], dtype=np.int64)
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum(sizes + 1)
    histogram = np.zeros(docs * 256)
    found = []
    lines_before = 0
    with np.errstate(over="ignore"):
        for a, b in _segments(data):
            part = data[a:b]
            doc = np.searchsorted(ends, np.arange(a, b), side="right") if docs > 1 else np.zeros(b - a, dtype=np.int64)
            histogram += np.bincount(doc * 256 + part, minlength=docs * 256)
            starts, stops = word_bounds(part)
            line = np.cumsum(part == 10)
            upper = np.concatenate([[0], np.cumsum((part >= 65) & (part <= 90))])
            plain = np.concatenate([[0], np.cumsum(((part | 32) >= 97) & ((part | 32) <= 122) | (part >= 128))])
            found.append((
                doc[starts], Rolling(part).spans(starts, stops), stops - starts, line[starts] + lines_before,
                upper[stops] - upper[starts] == stops - starts, plain[stops] - plain[starts],
            ))
            lines_before += int(line[-1])
        histogram = histogram.reshape(docs, 256)
        histogram[:, 10] -= 1  # the separators
        word_doc, name, length, line, caps, letters = (np.concatenate(x) for x in zip(*found))
        words = np.bincount(word_doc, minlength=docs).astype(np.float64)
        some, most = np.maximum(words, 1), np.maximum(sizes, 1)
        mean = lambda x: np.bincount(word_doc, weights=x, minlength=docs) / some
        distinct, commonest = _distinct(word_doc, name, docs)
        after = word_doc[1:] == word_doc[:-1]
        again = np.bincount(word_doc[1:], weights=after & (name[1:] == name[:-1]), minlength=docs)
        pair = mixed(name[:-1] * np.uint64(3) + name[1:])
        pairs = _distinct(word_doc[1:][after], pair[after], docs)[0]
        three = after[1:] & after[:-1]
        triples = _distinct(word_doc[2:][three], mixed(pair[:-1] * np.uint64(5) + name[2:])[three], docs)[0]
        # a line is the sum of its words' hashes by place
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, dtype=int)
        place = np.arange(len(line)) - np.repeat(first, np.diff(np.append(first, len(line))))
        of_line = np.add.reduceat(mixed(name + place.astype(np.uint64)), first) if len(first) else name
        lines = np.bincount(word_doc[first], minlength=docs).astype(np.float64)
        different = _distinct(word_doc[first], of_line, docs)[0]
    shares = histogram @ _OF_CLASS / most[:, None]
    by_byte = histogram / most[:, None]
    entropy = -(by_byte * np.log2(np.where(by_byte > 0, by_byte, 1))).sum(1)
    size_mean = mean(length)
    spread = np.sqrt(np.maximum(mean(length.astype(np.float64) ** 2) - size_mean**2, 0))
    longest = np.zeros(docs)
    np.maximum.at(longest, word_doc, length)
    symbols, stops_ = (shares[:, list(_CLASSES).index(c)] * most / some for c in ("symbol", "stop"))
    return np.column_stack([
        np.log1p(sizes), np.log1p(words), np.log1p(lines), words / np.maximum(lines, 1), histogram[:, 128:].sum(1) / most,
        (histogram[:, :9].sum(1) + histogram[:, 14:32].sum(1)) / most, shares, symbols, stops_, entropy, size_mean, spread,
        np.log1p(longest), mean(length <= 3), distinct / np.sqrt(some), commonest / some, again / some, pairs / some,
        triples / some, 1 - np.where(lines > 0, different / np.maximum(lines, 1), 1), mean(letters * 2 < length), mean(caps),
    ])


@dataclass
class Trees:
    """Flattened trees: split statistic and border of the inner nodes, value of the leaves, all of one depth."""

    statistic: np.ndarray
    border: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1, by walking all trees at once."""
        trees, inner = self.statistic.shape
        node = np.zeros((len(x), trees), dtype=np.int64)
        every = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.statistic[every, node]] > self.border[every, node])
        return self.base + self.leaf[every, node - inner].sum(1)

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """Probability of label 1 for whole texts, some at a time so that their statistics stay small."""
        out, start, held = [], 0, 0
        for k, text in enumerate(texts):
            held += len(text or "")
            if held > SEGMENT or k == len(texts) - 1:
                out.append(self.raw(statistics_of(texts[start : k + 1])))
                start, held = k + 1, 0
        raw = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosts trees on logistic loss; a node without a gainful split sends all its rows left."""
    rows, width = x.shape
    inner = (1 << depth) - 1
    borders = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(width)]
    bins = np.column_stack([np.searchsorted(borders[k], x[:, k], side="left") for k in range(width)])
    flat = bins + np.arange(width) * BINS
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), 0.0)
    out.base = float(np.log((y.sum() + 1) / (rows - y.sum() + 1)))
    raw = np.full(rows, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(rows, dtype=np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * width * BINS + flat).ravel()
            g, h = (
                np.bincount(cell, weights=np.repeat(v, width), minlength=count * width * BINS).reshape(count, width, BINS)
                for v in (slope, bend)
            )
            left_g, left_h = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
            all_g, all_h = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
            gain = (
                left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY) - all_g**2 / (all_h + PENALTY)
            )
            gain[(left_h < 1) | (all_h - left_h < 1)] = 0
            best = gain.reshape(count, -1).argmax(1)
            column, at = best // (BINS - 1), best % (BINS - 1)
            for n in range(count):
                if gain[n, column[n], at[n]] > 1e-6 and at[n] < len(borders[column[n]]):
                    out.statistic[t, first + n], out.border[t, first + n] = column[n], borders[column[n]][at[n]]
            node = 2 * node + 1 + (x[np.arange(rows), out.statistic[t, node]] > out.border[t, node])
        leaf = node - inner
        total_g, total_h = (np.bincount(leaf, weights=v, minlength=inner + 1) for v in (slope, bend))
        out.leaf[t] = -LEARNING_RATE * total_g / (total_h + PENALTY)
        raw += out.leaf[t][leaf]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, seed: int = 42) -> Trees:
    """Learns from docs (doc_id, text) and labels (doc_id, quality 0 or 1); of several labels of one id the smallest counts.

    Of each class, at most SLICES times ROWS_PER_SLICE labelled rows in the order of a seeded digest are used, with whole
    texts. Their statistics, a row of len(FEATURES) numbers each, go to the driver. Without labels every score is 0.5; with
    one class it is that class's smoothed share.
    """
    known = (
        labels.where("quality is not null and doc_id is not null").groupBy("doc_id")
        .agg(F.min(F.col("quality").cast("int")).alias("quality"))
    )
    digest = F.xxhash64("doc_id", F.lit(seed))
    chosen = (
        known.withColumn("slice", F.pmod(digest, F.lit(SLICES)))
        .withColumn("n", F.row_number().over(W.partitionBy("quality", "slice").orderBy(digest, "doc_id")))
        .where(F.col("n") <= ROWS_PER_SLICE).select("doc_id", "quality")
    )
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    @F.pandas_udf("array<double>")
    def measured(texts):
        import pandas as pd

        held = texts.tolist()
        return pd.Series([row for k in range(0, len(held), 64) for row in statistics_of(held[k : k + 64]).tolist()])

    table = sample.select("doc_id", F.col("quality").cast("double").alias("y"), measured("text").alias("x")).toArrow()
    if not table.num_rows:
        return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    y, ids = (table.column(c).to_numpy() for c in ("y", "doc_id"))
    order = np.lexsort((*x.T, ids))  # however the rows came, sums run in one order
    return grow(x[order], y[order], trees=TREES if 0 < y.sum() < len(y) else 0)


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; learned from labels of the other folds (crc32 of the id).

    Null and empty texts get the score of a text whose statistics are all 0. A null doc_id is no row of the held fold and
    has no label. Repeated rows are scored each; other columns are not read.
    """
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select("doc_id", "text", fold(F.col("doc_id")).alias("held_out"))
    model = fit_quality(rows.where("not held_out"), labels.where(~fold(F.col("doc_id"))))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(held.value.scores(texts.tolist()), dtype="float64")

    scored = rows.select("doc_id", "held_out", score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
