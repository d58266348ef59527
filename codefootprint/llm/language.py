"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its hashed subwords (runs of 2 to 4 bytes of the lower-cased letters, word
borders included). Embeddings and the softmax layer are trained together by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.store import small_batches, unused_name

BUCKETS = 1 << 12
DIMENSIONS = 16
#: Bounds of the training sample: rows of one language (a limit that Spark applies before it shuffles), and languages (the
#: most frequent ones).
ROWS_PER_LANGUAGE = 1000
MAX_LANGUAGES = 256
EPOCHS = 12
#: Of held-back training rows, at most this share may score below the rejection threshold.
REJECTED_SHARE = 0.001
UNDETERMINED = "und"

_LETTERS = np.full(256, ord(" "), dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def subword_counts(text: str) -> np.ndarray:
    """How often each bucket's subwords stand in the whole text."""
    data = _LETTERS[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)].astype(np.uint32)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    run = data
    for k in range(1, 4):
        if len(data) <= k:
            break
        run = run[:-1] * np.uint32(257) + data[k:]
        counts += np.bincount((run * np.uint32(0x9E3779B1)) >> np.uint32(20), minlength=BUCKETS)
    return counts


@dataclass
class LanguageModel:
    """Class names, the folded layer (embedding times softmax weights), its bias, temperature and rejection threshold."""

    languages: list[str]
    layer: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        counts = subword_counts(text)
        logits = (counts @ self.layer / counts.sum() + self.bias) / self.temperature
        shares = np.exp(logits - logits.max())
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best] / shares.sum())


def _train(x: np.ndarray, y: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax weights, and biases, by minibatch descent with per-parameter step sizes."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (x.shape[1], DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, n)), np.zeros(n)]
    seen = [np.full(p.shape, 1e-8) for p in params]
    for epoch in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            batch = x[rows]
            hidden = batch @ params[0]
            logits = hidden @ params[1] + params[2]
            shares = np.exp(logits - logits.max(axis=1, keepdims=True))
            shares /= shares.sum(axis=1, keepdims=True)
            shares[np.arange(len(rows)), y[rows]] -= 1
            shares /= len(rows)
            for p, s, grad in zip(params, seen, (batch.T @ (shares @ params[1].T), hidden.T @ shares, shares.sum(axis=0))):
                s += grad * grad
                p -= 0.3 / (1 + epoch / 4) * grad / np.sqrt(s)
    return params[0] @ params[1], params[2]


def fit_language(docs: DataFrame, seed: int = 42) -> LanguageModel:
    """Learns from docs (doc_id, text, lang): a seeded sample of at most ROWS_PER_LANGUAGE rows of each language.

    Rows without language or without a letter teach nothing. A tenth of the sample is held back to fit the temperature and
    the rejection threshold. Only bucket counts of whole texts reach the driver, at most BUCKETS per row.
    """
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "lang")
    common = [r[0] for r in labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()]
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
    chosen = (
        labelled.where(F.col("lang").isin(common))
        .withColumn("n", F.row_number().over(order))
        .where(F.col("n") <= ROWS_PER_LANGUAGE)
        .select("doc_id")
        .distinct()
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if has_letter(text):
                    counts = subword_counts(text)
                    at = np.flatnonzero(counts)
                    rows.append((lang, at.astype("<u2").tobytes(), (counts[at] / counts.sum()).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_pydict(
                {k: [r[i] for r in rows] for i, k in enumerate(("lang", "at", "share"))},
                schema=pa.schema([("lang", pa.string()), ("at", pa.binary()), ("share", pa.binary())]),
            )

    # the sample's size is bounded by two parameters, so it may be broadcast
    texts = docs.where(F.col("lang").isin(common) & F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = texts.select("lang", "text").mapInArrow(count, "lang string, at binary, share binary").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.share)))
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    languages = sorted({r.lang for r in rows})
    x = np.zeros((len(rows), BUCKETS), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r.at, dtype="<u2")] = np.frombuffer(r.share, dtype="<f4")
    y = np.array([languages.index(r.lang) for r in rows])
    held = np.random.default_rng(seed).random(len(y)) < 0.1
    if len(y) < 50 or held.all() or not held.any():
        held = np.zeros(len(y), dtype=bool)
    layer, bias = _train(x[~held], y[~held], len(languages), seed)
    check = held if held.any() else ~held
    logits = x[check] @ layer + bias

    def shares(temperature: float) -> np.ndarray:
        e = np.exp((logits - logits.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    def loss(temperature: float) -> float:
        return -float(np.log(np.maximum(shares(temperature)[np.arange(check.sum()), y[check]], 1e-12)).mean())

    temperature = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    threshold = min(0.5, float(np.quantile(shares(temperature).max(axis=1), REJECTED_SHARE)))
    return LanguageModel(languages, layer, bias, temperature, threshold)


def with_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to docs, from the whole ``text`` only.

    Null texts and texts without a letter get ``und`` and 0, and so does every text if nothing was learned. Rows, order of
    columns and other columns stay; a column of the same name is replaced.
    """
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts):
        import pandas as pd

        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = unused_name(docs, "found")
    return docs.withColumn(found, predict("text")).select(*(F.col(f"`{c}`") for c in kept), f"{found}.lang_pred", f"{found}.score")


def identify_languages(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of the other folds (crc32 of the id) only.

    A null doc_id is no row of the held fold.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    rows = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit_language(rows.where("not held_out"))
    return with_language(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """The rows of docs whose language is found with a score at or above the calibrated threshold; all columns stay.

    Learns from all rows that have a language. Rejected are null texts, texts without a letter and texts below the
    threshold, and, if ``wanted`` is given, texts of other languages. If nothing could be learned, all rows stay.
    """
    small_batches(docs.sparkSession)
    model = fit_language(docs)
    if not model.languages:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def accepted(texts):
        import pandas as pd

        found = (held.value.predict(t) for t in texts)
        return pd.Series([lang != UNDETERMINED and score >= held.value.threshold and (not wanted or lang in wanted) for lang, score in found])

    return docs.where(accepted("text"))
