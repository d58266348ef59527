"""Toxicity: class-conditional Kneser-Ney models of words, compared by length-normalised likelihood.

A word is spelled from its start, byte by byte: each byte's probability depends on all the word's bytes before it, beyond
LONGEST of them on the last ones (a sliding run of LONGEST bytes), so every byte counts. A toxic and an ordinary model have counts of their own class; what they discount goes to one shared model
of both classes' counts, and what that discounts to continuation counts (distinct left neighbours) of three-byte runs. So
an expression that is rare in either class is smoothed alike in both. The log-likelihood difference of a word, and that of
a text by the number of its words and bytes, are compared; a logistic layer fitted on texts that gave no counts turns them
into a probability.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.words import mixed

#: Bytes of the longest run (a word's end counts as one), and the order of the continuation counts.
LONGEST = 12
SHARED_ORDER = 3
DISCOUNT = 0.75
BUCKET_BITS = 21
#: The models: ordinary, toxic, and both together.
KINDS = (0, 1, 2)
#: Bound of the training sample: slices of each class by digest, and rows of a slice (a limit that Spark applies before it
#: shuffles).
SLICES = 16
ROWS_PER_SLICE = 250
PREDICT_AT = 0.7

_BYTES = np.full(256, ord(" "), dtype=np.uint8)
_BYTES[128:] = np.arange(128, 256)
_BYTES[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_TABLE = mixed(np.arange(1, 257, dtype=np.uint64))


@functools.cache
def borders() -> dict[int, str]:
    """Punctuation, symbols and spaces beyond ASCII, which are borders of words like those within it."""
    return dict.fromkeys((c for c in range(128, 0x110000) if unicodedata.category(chr(c))[0] in "PSZ"), " ")


def letters(text: str) -> np.ndarray:
    """Lower-cased UTF-8 bytes of the text's words, each word behind one space, one space at the end."""
    if not text.isascii():
        text = text.translate(borders())
    data = _BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)]
    space = data == ord(" ")
    return data[~(space & np.concatenate([[False], space[:-1]]))]


def byte_runs(data: np.ndarray, order: int) -> np.ndarray:
    """Buckets of the runs of ``order`` bytes, by the place of the last byte."""
    n = len(data) - order + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, order, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(order):
            h = (h ^ _TABLE[data[k : n + k]]) * np.uint64(0x9E3779B97F4A7C15)
    return _bucket(h)


def _bucket(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h << np.uint64(32))) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def spelled(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each step of spelling: the words that reach it, the place of its byte, and the buckets before and behind it.

    The last step has all bytes beyond LONGEST, so a word may stand in it more than once.
    """
    starts = np.flatnonzero(data == ord(" "))
    if len(starts) < 2:
        return
    words, ends = np.arange(len(starts) - 1), starts[1:]
    h = np.full(len(words), 7, dtype=np.uint64)
    before = _bucket(h)
    for k in range(1, LONGEST + 1):
        reach = starts[words] + k <= ends[words]
        words, h, before = words[reach], h[reach], before[reach]
        if not len(words):
            return
        at = starts[words] + k
        with np.errstate(over="ignore"):
            h = (h ^ _TABLE[data[at]]) * np.uint64(0x9E3779B97F4A7C15)
        whole = _bucket(h)
        yield words, at, before, whole
        before = whole
    lengths = ends - starts[:-1]
    over = np.maximum(lengths - LONGEST, 0)
    if over.any():
        words = np.repeat(np.arange(len(over)), over)
        at = np.arange(len(words)) - np.repeat(np.cumsum(over) - over, over) + (starts[:-1] + LONGEST + 1)[words]
        yield words, at, byte_runs(data, LONGEST - 1)[at - LONGEST + 1], byte_runs(data, LONGEST)[at - LONGEST + 1]


def at_in_word(starts: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of each byte in its word, from 1."""
    return at - starts[words]


@dataclass
class ToxicityModel:
    """Continuation table; per model the discounted share by prefix and the backoff weight by context; logistic weights."""

    continuation: np.ndarray
    shares: list[np.ndarray]
    backoffs: list[np.ndarray]
    weights: np.ndarray

    def word_ratios(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood difference (toxic less ordinary) summed over each word's bytes; the words' lengths and names (sums of buckets by place)."""
        starts = np.flatnonzero(data == ord(" "))
        sums = np.zeros(max(0, len(starts) - 1))
        names = np.zeros(len(sums), dtype=np.int64)
        low = np.full(len(data), 1 / 256, dtype=np.float32)
        if len(data) >= SHARED_ORDER:
            low[SHARED_ORDER - 1 :] = self.continuation[byte_runs(data, SHARED_ORDER)]
        for words, at, before, whole in spelled(data):
            both = self.shares[2][whole] + self.backoffs[2][before] * low[at]
            ordinary, toxic = (self.shares[k][whole] + self.backoffs[k][before] * both for k in (0, 1))
            sums += np.bincount(words, weights=np.log(toxic / ordinary), minlength=len(sums))
            place = whole * at_in_word(starts, words, at)
            if at[0] - starts[words[0]] <= LONGEST:  # a step in which each word stands once
                names[words] += place
            else:
                np.add.at(names, words, place)
        return sums, np.diff(starts).astype(np.float64), names

    def features(self, text: str | None) -> np.ndarray:
        """Mean difference per word and per byte, how many words are clearly toxic, and the largest different words."""
        if not text:
            return np.zeros(6)
        sums, lengths, names = self.word_ratios(letters(text))
        if not len(sums):
            return np.zeros(6)
        top = np.append(np.sort(sums[np.unique(names, return_index=True)[1]])[::-1][:3], np.zeros(3))
        return np.array([
            np.tanh(sums.mean()), np.tanh((sums / lengths).mean() * 10), np.clip(top[0], 0, 12) / 10,
            np.clip(top[2], 0, 12) / 10, np.log1p((sums > 4).sum()), np.log1p(len(sums)) / 5,
        ])

    def score(self, text: str | None) -> float:
        z = float(np.append(self.features(text), 1.0) @ self.weights)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights with a bias last, by Newton steps on a lightly penalised loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.eye(x.shape[1]) * 0.3
    penalty[-1, -1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tables(counted: pa.Table) -> ToxicityModel | None:
    """Model tables of a fixed size from run counts (kind, context, whole, n), column by column; None if a class has none."""
    kind, context, whole, n = (counted.column(c).to_numpy() for c in ("kind", "context", "whole", "n"))
    size = 1 << BUCKET_BITS
    left = np.bincount(whole[kind == 3], minlength=size) + 0.1
    at = np.flatnonzero(kind == 4)
    around = np.bincount(context[at], weights=left[whole[at]], minlength=size)
    continuation = np.full(size, 1e-3, dtype=np.float32)
    continuation[whole[at]] = left[whole[at]] / around[context[at]]
    del left, around
    shares, backoffs = [], []
    for k in KINDS:
        at = np.flatnonzero(kind == k if k < 2 else kind < 2)
        if not len(at):
            return None
        # in the shared model a run that both classes have is one run
        keys, place = np.unique(context[at].astype(np.int64) << BUCKET_BITS | whole[at], return_inverse=True)
        seen = np.bincount(place, weights=n[at])
        before, run = keys >> BUCKET_BITS, keys & (size - 1)
        totals = np.bincount(before, weights=seen, minlength=size)
        kinds = np.bincount(before, minlength=size)
        share = np.zeros(size, dtype=np.float32)
        np.maximum.at(share, run, (np.maximum(seen - DISCOUNT, 0) / totals[before]).astype(np.float32))
        shares.append(share)
        backoffs.append(np.where(totals > 0, DISCOUNT * kinds / np.maximum(totals, 1), 1).astype(np.float32))
    return ToxicityModel(continuation, shares, backoffs, np.zeros(7))


def fit_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 42) -> ToxicityModel | None:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic 0 or 1); None if a class has no text.

    A seeded sample of at most SLICES times ROWS_PER_SLICE labelled rows of each class is used, with whole texts: three quarters give
    the counts, a quarter the logistic layer. Several labels of one id count as toxic if one of them is. Run counts are
    summed by Spark; the driver gets at most one row per bucket, order and class.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    digest = F.xxhash64("doc_id", F.lit(seed))
    chosen = (
        known.withColumn("slice", F.pmod(digest, F.lit(SLICES)))
        .withColumn("n", F.row_number().over(W.partitionBy("toxic", "slice").orderBy(digest, "doc_id")))
        .where(F.col("n") <= ROWS_PER_SLICE)
        .select("doc_id", "toxic", (F.col("n") % 4 == 0).alias("fits_layer"))
    )
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        waiting = 0

        def pack() -> Iterator[pa.RecordBatch]:
            for kind, parts in held.items():
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), kind, np.int32)), pa.array((keys >> BUCKET_BITS).astype(np.int32)), pa.array((keys & ((1 << BUCKET_BITS) - 1)).astype(np.int32)), pa.array(n.astype(np.int64))],
                    names=["kind", "context", "whole", "n"],
                )
            held.clear()

        for batch in batches:
            for text, kind in zip(batch.column(0), batch.column(1).to_pylist()):
                data = letters(text.as_py())
                for _, _, before, whole in spelled(data):
                    held.setdefault(kind, []).append((before << BUCKET_BITS) | whole)
                # for continuation counts: 3 pairs a run with its left neighbour (a run of one byte more), 4 with its context
                whole = byte_runs(data, SHARED_ORDER)[1:]
                held.setdefault(3, []).append((byte_runs(data, SHARED_ORDER + 1) << BUCKET_BITS) | whole)
                held.setdefault(4, []).append((byte_runs(data, SHARED_ORDER - 1)[1:-1] << BUCKET_BITS) | whole)
                waiting += len(data)
            if waiting > 2_000_000:
                waiting = 0
                yield from pack()
        yield from pack()

    table = (
        sample.where("not fits_layer").select("text", "toxic").mapInArrow(count, "kind int, context int, whole int, n long")
        .groupBy("kind", "context", "whole").agg(F.sum("n").alias("n"))
    )
    model = _tables(table.toArrow())
    if model is None:
        return None
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def features(texts):
        import pandas as pd

        return pd.Series([held.value.features(t).tolist() for t in texts])

    rows = sample.where("fits_layer").select("doc_id", "toxic", features("text").alias("x")).orderBy("doc_id").collect()
    if len({r.toxic for r in rows}) == 2:
        model.weights = _logistic(np.array([r.x for r in rows]), np.array([r.toxic for r in rows], dtype=float))
    else:
        model.weights = np.array([2.0, 1.0, 2.0, 1.0, 1.0, 1.0, -5.0])
    held.unpersist()
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3, held_fold: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; learned from labels of the other folds (crc32 of the id).

    Null and empty texts get the score of a text that says nothing either way. Without texts of both classes nothing can
    be learned and all scores are 0. A null doc_id is no row of the held fold; extra columns are not read.
    """
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select("doc_id", "text", fold(F.col("doc_id")).alias("held_out"))
    model = fit_toxicity(rows.where("not held_out"), labels.where(~fold(F.col("doc_id"))))
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series([held.value.score(t) if held.value else 0.0 for t in texts], dtype="float64")

    scored = rows.select("doc_id", "held_out", score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= PREDICT_AT).cast("int"))
