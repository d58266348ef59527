"""Benchmark decontamination by latent semantic retrieval, with word-sequence and answer checks of what it finds.

Benchmark texts and passages of documents (windows of WINDOWS words that overlap) are TF-IDF vectors over hashed
words, with document frequencies of the whole corpus. A randomised singular value decomposition of the benchmark's
vectors, summed up by Spark over their partitions, gives a latent space; passages are projected into it and compared with
every benchmark text by cosine. Candidates are then checked word by word: the longest common subsequence with the
benchmark text must cover most of it, or a good part of it and the answer (its last words) as well.

A document is compared with the texts of which it holds one of the rarest words: a passage with the accepted share of a text lacks
so few of its words that it must hold one of those, so this loses nothing that the checks would accept.

A block of texts has a space of its own with as many directions as texts (RANK at most), so the space holds them whole; what
the iteration still loses of a text is measured and added to its cosines, which so never fall below the true ones.

The benchmark is a stated query set: it is taken in groups of about GROUP_ITEMS texts, so what tasks hold of it is bounded,
and every document is compared with every block of every group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefootprint.llm.words import word_hashes

#: Lengths of windows; an item is compared with those next to its own length, a longer one than LONGEST in passages of the
#: last length that overlap by half.
WINDOWS = (4, 8, 16, 32)
LONGEST = 48
#: A window begins at every STEPS-th part of its length.
STEPS = 4
WORD_BITS = 18
RANK = 224
POWER_ROUNDS = 2
GROUP_ITEMS = 4096
#: Part of the cosine that a passage of the accepted share reaches with words of even weight, from which it is a candidate
#: (changed words may be rare and the common ones frequent); shares of the benchmark text that the common subsequence must
#: cover, alone or together with a found answer; words of the answer.
SLACK = 0.25
COVERED = 0.8
COVERED_WITH_ANSWER = 0.6
ANSWER_WORDS = 6

#: Bytes of words: letters, digits and everything beyond ASCII; the rest separates.
_KEPT = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def plain(text: str | None) -> bytes:
    """UTF-8 bytes of the whole text in lower case, with blanks for punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_KEPT)


def buckets(data: bytes) -> np.ndarray:
    return (word_hashes(data)[0] >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each word bucket, and the number of documents; one sum per bucket reaches the driver."""
    size = 1 << WORD_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                found[np.unique(buckets(plain(text.as_py())))] += 1
                found[size] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, dtype=np.int64)
    out[rows.bucket] = rows.n
    return out[:size], int(out[size])


def _vector(own: np.ndarray, idf: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a benchmark text's unit TF-IDF vector."""
    words, n = np.unique(own, return_counts=True)
    weight = n * idf[words]
    return place[words], weight / max(np.sqrt((weight**2).sum()), 1e-12)


def fit_space(items: DataFrame, idf: np.ndarray, place: np.ndarray, width: int, seed: int = 42) -> np.ndarray:
    """Orthonormal directions (width x RANK at most) that hold most of the items' vectors, by randomised iteration.

    Each round sends a block of directions Q to the tasks, which return the sum of v (v Q) over their items' vectors v, one
    matrix a task; the driver makes the sum's columns orthonormal.
    """
    spark = items.sparkSession
    q = np.random.default_rng(seed).normal(size=(width, min(RANK, width))).astype(np.float32)
    for _ in range(POWER_ROUNDS + 1):
        held = spark.sparkContext.broadcast((q, idf, place))

        def multiply(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            q, idf, place = held.value
            total = np.zeros_like(q)
            for batch in batches:
                for text in batch.column(0):
                    at, weight = _vector(buckets(plain(text.as_py())), idf, place)
                    total[at] += np.outer(weight, weight @ q[at])
            at = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"at": at, "row": [total[i].tobytes() for i in at]}, schema=pa.schema([("at", pa.int64()), ("row", pa.binary())]))

        total = np.zeros(q.shape)
        for r in items.select("text").mapInArrow(multiply, "at long, row binary").toLocalIterator():
            total[r["at"]] += np.frombuffer(bytes(r.row), dtype=np.float32)
        q = np.linalg.qr(total)[0].astype(np.float32)
        held.unpersist()
    return q


@dataclass
class Block:
    """Some of the benchmark's texts: latent score of each word for each text, which words are among a text's rarest, how often
    each stands in it and how many of its words a document must hold, what the space loses of each text, the cosine from which it is a candidate, and its number among the group's items."""

    place: np.ndarray
    scores: np.ndarray
    rare: np.ndarray
    counts: np.ndarray
    needed: np.ndarray
    lost: np.ndarray
    cutoffs: np.ndarray
    owners: np.ndarray
    window: int

    def hits(self, own: np.ndarray, weight: np.ndarray, different: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """First words, item numbers and cosines of the windows that are near a text of the block in the latent space.

        Only texts of which the document holds one of the rarest words are looked at; no other can pass the later checks.
        """
        place = self.place[different]
        place = place[place >= 0]
        texts = np.flatnonzero(self.rare[place].any(axis=0))
        # nor can one of which the document holds too few words
        texts = texts[self.counts[np.ix_(place, texts)].sum(axis=0, dtype=np.int32) >= self.needed[texts]]
        if not len(texts):
            return
        n, stride = len(own), self.window // STEPS
        place = self.place[own]
        known = np.flatnonzero(place >= 0)
        energy = np.concatenate([[0], np.cumsum(weight**2)])
        windows = max(1, -(-n // stride) - STEPS + 1)
        for a in range(0, windows, 256):
            first = np.arange(a, min(a + 256, windows)) * stride
            last = np.minimum(first + self.window, n)
            low, high = np.searchsorted(known, first), np.searchsorted(known, last)
            some = known[low[0] : high[-1]]
            part = self.scores[np.ix_(place[some], texts)] * weight[some, None]
            sums = np.vstack([np.zeros(len(texts)), np.cumsum(part, axis=0)])
            inner = sums[high - low[0]] - sums[low - low[0]]
            size = energy[last] - energy[first]
            # a word that repeats makes the passage longer than this, so the cosine errs to the side of more candidates
            cosine = inner / np.sqrt(np.maximum(size, 1e-12))[:, None] + self.lost[texts]
            k, text = np.nonzero((cosine >= self.cutoffs[texts]) & (size > 0)[:, None])
            if len(k):
                yield first[k], self.owners[texts[text]], cosine[k, text]


def least_words(length: int) -> int:
    """Words of a text of this length that a passage must have to cover the share COVERED_WITH_ANSWER."""
    return int(np.ceil(COVERED_WITH_ANSWER * length - 1e-9))


def rarest(own: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Words of which a passage that covers the share COVERED_WITH_ANSWER of a text holds one at least: the rarest of them, one
    more than the passage may lack."""
    return own[np.argsort(-idf[own], kind="stable")[: len(own) - least_words(len(own)) + 1]]


@dataclass
class Searcher:
    """A group of the benchmark: word weights, blocks of its texts, ids and word sequences of its items."""

    idf: np.ndarray
    blocks: list[Block]
    ids: list[int]
    words: list[list[bytes]]

    def candidates(self, own: np.ndarray) -> dict[int, list[tuple[int, float]]]:
        """Windows (first word, cosine) of a text, by item, that are near the item in the latent space."""
        if not len(own) or not self.ids:
            return {}
        weight = self.idf[own]
        different = np.unique(own)
        parts = [hit for block in self.blocks for hit in block.hits(own, weight, different)]
        if not parts:
            return {}
        first, item, cosine = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(item, kind="stable")
        borders = np.flatnonzero(np.diff(item[order])) + 1
        return {int(item[at[0]]): list(zip(first[at].tolist(), cosine[at].tolist())) for at in np.split(order, borders)}

    def search(self, text: str | None) -> list[tuple[int, float, float, bool]]:
        """(item_id, similarity, cosine, answer_found) of each benchmark text that a text leaks."""
        data = plain(text)
        out = []
        near = self.candidates(buckets(data))
        words = data.split() if near else []
        for item, windows in near.items():
            own = self.words[item]
            best = (0.0, False)
            for first, last in _spans(windows, len(own)):
                passage = words[max(0, first) : last]
                # no more words can be common than stand in the passage at all
                if sum(map(set(passage).__contains__, own)) < COVERED_WITH_ANSWER * len(own):
                    continue
                share = common_words(own, passage) / len(own)
                if share >= COVERED_WITH_ANSWER:
                    answer = own[-ANSWER_WORDS:]
                    best = max(best, (share, common_words(answer, passage) == len(answer)))
            if best[0] >= COVERED or best[1]:
                out.append((self.ids[item], best[0], max(c for _, c in windows), best[1]))
        return out


def _spans(windows: list[tuple[int, float]], length: int) -> list[tuple[int, int]]:
    """Stretches of words around windows, with room for the whole item; those that overlap become one, if it stays short."""
    out: list[tuple[int, int]] = []
    for first, _ in sorted(windows):
        a, b = first - length, first + WINDOWS[-1] + length
        if out and a < out[-1][1] - length and b - out[-1][0] <= 6 * length + WINDOWS[-1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def common_words(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, with one bit per word of ``a`` and one addition per word of ``b``."""
    places: dict[bytes, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for w in b:
        hit = rest & places.get(w, 0)
        rest = ((rest + hit) | (rest - hit)) & full
    return len(a) - rest.bit_count()


def pieces(words: list[bytes]) -> list[tuple[int, list[bytes]]]:
    """What of an item is compared with windows, each with the length of those windows.

    Of a long item that a document covers by some share, one passage at least is covered by that share.
    """
    n = len(words)
    if n <= LONGEST:
        return [(min(WINDOWS, key=lambda w: max(w, n) / min(w, n)), words)]
    width = WINDOWS[-1]
    return [(width, words[a : a + width]) for a in [*range(0, n - width, width // 2), n - width]]


def cutoff(length: int, window: int) -> float:
    """Cosine from which a window is a candidate for a piece of so many words.

    A stretch of a window's length that covers the share COVERED_WITH_ANSWER evenly has that share of the shorter one's
    words in common, so its cosine is about the share times the root of the shorter by the longer.
    """
    return SLACK * COVERED_WITH_ANSWER * (min(length, window) / max(length, window)) ** 0.5


def _block(spark: SparkSession, idf: np.ndarray, window: int, texts: list[tuple[int, bytes]]) -> Block:
    """Space and scores of at most RANK texts (number of the item, words)."""
    own = [buckets(t) for _, t in texts]
    known = np.unique(np.concatenate(own))
    place = np.full(1 << WORD_BITS, -1, dtype=np.int64)
    place[known] = np.arange(len(known))
    rows = spark.createDataFrame([(t.decode("utf-8", "replace"),) for _, t in texts], "text string")
    directions = fit_space(rows, idf, place, len(known))
    vectors = [_vector(b, idf, place) for b in own]
    latent = np.stack([w @ directions[at] for at, w in vectors])
    lost = np.sqrt([max(0.0, (w**2).sum() - (x**2).sum()) for (_, w), x in zip(vectors, latent)])
    scores = (directions @ latent.T).astype(np.float32)
    cutoffs = np.array([cutoff(len(t.split()), window) for _, t in texts])
    rare, counts = np.zeros(scores.shape, dtype=bool), np.zeros(scores.shape, dtype=np.uint16)
    for k, b in enumerate(own):
        rare[place[rarest(b, idf)], k] = True
        np.add.at(counts[:, k], place[b], 1)
    needed = np.array([least_words(len(b)) for b in own])
    return Block(place.astype(np.int32), scores, rare, counts, needed, lost.astype(np.float32), cutoffs.astype(np.float32), np.array([i for i, _ in texts]), window)


def searchers(docs: DataFrame, benchmark: DataFrame) -> Iterator[Searcher]:
    """A searcher for each group of the benchmark, fitted with the document frequencies of docs."""
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    ids, words, waiting, blocks, size = [], [], {}, [], 0

    def close() -> Searcher:
        nonlocal ids, words, waiting, blocks, size
        blocks += [_block(docs.sparkSession, idf, w, texts) for w, texts in waiting.items() if texts]
        out = Searcher(idf, blocks, ids, words)
        ids, words, waiting, blocks, size = [], [], {}, [], 0
        return out

    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    given = False
    for r in items.orderBy("item_id", "text").toLocalIterator():
        own = plain(r.text).split()
        if not own:
            continue
        for window, piece in pieces(own):
            texts = waiting.setdefault(window, [])
            texts.append((len(ids), b" ".join(piece)))
            size += 1
            if len(texts) == RANK:
                blocks.append(_block(docs.sparkSession, idf, window, waiting.pop(window)))
        ids.append(r.item_id)
        words.append(own)
        if size >= GROUP_ITEMS:
            given = True
            yield close()
    if ids or not given:
        yield close()


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, cosine, answer_found: one row for each document and benchmark text that it leaks.

    docs: doc_id, text; benchmark: item_id, text; other columns are not read. similarity is the share of the benchmark
    text's words in the common subsequence. Null and blank texts on either side leak nothing; repeated rows of docs give
    repeated rows; items of equal text are found under each of their ids; empty tables give no rows.
    """
    out = None
    for searcher in searchers(docs, benchmark):
        held = docs.sparkSession.sparkContext.broadcast(searcher)

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in held.value.search(t.as_py())]
                kinds = (("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("cosine", pa.float64()), ("answer_found", pa.bool_()))
                yield pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, (k, _) in enumerate(kinds)}, schema=pa.schema(kinds))

        part = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, item_id long, similarity double, cosine double, answer_found boolean")
        out = part if out is None else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that leak a benchmark text; all columns stay."""
    for searcher in searchers(docs, benchmark):
        held = docs.sparkSession.sparkContext.broadcast(searcher)

        @F.pandas_udf("boolean")
        def clean(texts, held=held):
            import pandas as pd

            return pd.Series([not held.value.search(t) for t in texts], dtype="bool")

        docs = docs.where(clean("text"))
    return docs
