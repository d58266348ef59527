"""Phrase collocations by dynamic itemset counting.

Texts are dealt into shards by a digest, and the shards are scanned in a circle. Phrases of all lengths are counted in the
same scans: words from the first one, a longer phrase from the scan after both its subphrases (all words but the last, and
all but the first) have reached the threshold in what was counted so far, each for one full circle. Scanning ends when
the last active phrase has had its circle.

Which phrases are active is told to the tasks by a table of a fixed number of slots: a phrase's slot holds the first scan
after one of the slot's phrases got there. A shared slot can only activate a phrase too early, alike in all tasks and scans,
so every phrase that has a count has the count of one full circle; what does not reach the threshold is dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.store import Store
from codefootprint.llm.words import Rolling, mixed

#: Shards of the corpus; slots of each length's table of active phrases; bytes of text that a task counts at a time, and rows
#: it sends at a time.
SHARDS = 2
SLOT_BITS = 23
CHUNK = 6 << 20
ROWS = 1 << 16
NEVER = 255
#: A byte that no UTF-8 text has: the border of pieces.
BORDER = 0xFF

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[list(b".,;:!?\n\x0b\x0c\r")] = BORDER
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[ord(" "), ord("\t"), BORDER]] = True

#: Rows of a scan: the phrase, a line end and its language in one column (no phrase holds a line end); its first scan, plus LAST
#: for phrases of the last length.
_COUNTS = "key string, since int, n long"
LAST = 1000


class Pieces:
    """Words of joined pieces: numbers in a dictionary, and whether the next word stands in the same piece."""

    def __init__(self, lang: str, data: np.ndarray):
        gap = np.ones(len(data) + 2, dtype=bool)
        gap[1:-1] = _IS_GAP[data]
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[0::2], edges[1::2]
        piece = np.cumsum(data == BORDER, dtype=np.int64)[starts]
        self.joined = piece[1:] == piece[:-1]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        letters = data[~gap[1:-1]]
        words = pa.Array.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
        ).dictionary_encode()
        self.ids = words.indices.to_numpy()
        self.words = words.dictionary
        _, bounds, raw = self.words.buffers()
        bounds = np.frombuffer(bounds, dtype=np.int64, count=len(self.words) + 1) if len(self.words) else np.zeros(1, np.int64)
        own = Rolling(np.frombuffer(raw, dtype=np.uint8) if raw else np.zeros(0, np.uint8)).spans(bounds[:-1], bounds[1:])
        spoken = np.frombuffer(lang.encode(), dtype=np.uint8)
        tongue = Rolling(spoken).spans(np.zeros(1, np.int64), np.full(1, len(spoken)))[0]
        with np.errstate(over="ignore"):
            self.hashes = mixed(own * np.uint64(0x9E3779B97F4A7C15) + tongue)

    def starts(self, size: int) -> np.ndarray:
        """Places of all runs of ``size`` words within a piece."""
        ok = np.ones(max(0, len(self.ids) - size + 1), dtype=bool)
        for k in range(size - 1):
            ok &= self.joined[k : k + len(ok)]
        return np.flatnonzero(ok)

    def slots(self, at: np.ndarray, size: int) -> np.ndarray:
        """Slots of the runs at these places."""
        with np.errstate(over="ignore"):
            h = self.hashes[self.ids[at]]
            for k in range(1, size):
                h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + self.hashes[self.ids[at + k]])
        return (h >> np.uint64(64 - SLOT_BITS)).astype(np.int32)

    def counted(self, at: np.ndarray, size: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Different phrases among the runs at these places, how often each stands there, and one place of each."""
        key = self.ids[at].astype(np.int64)
        for k in range(1, size):
            if k > 1:  # so that keys stay small
                key = np.unique(key, return_inverse=True)[1]
            key = key * len(self.words) + self.ids[at + k]
        _, place, n = np.unique(key, return_index=True, return_counts=True)
        one = at[place]
        parts = [self.words.take(pa.array(self.ids[one + k])) for k in range(size)]
        joined = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if size > 1 else parts[0]
        return joined.cast(pa.binary()).cast(pa.string()), n, one


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """Folded bytes of texts of one language, at most CHUNK at a time or one piece that is longer."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    border = np.full(1, BORDER, dtype=np.uint8)

    def cut(lang: str) -> Iterator[tuple[str, np.ndarray]]:
        data = np.concatenate(held.pop(lang))
        sizes.pop(lang)
        start = 0
        while len(data) - start > CHUNK:
            back = np.flatnonzero(data[start : start + CHUNK] == BORDER)
            ahead = back[-1] if len(back) else _next_border(data, start + CHUNK) - start
            yield lang, data[start : start + ahead + 1]
            start += ahead + 1
        yield lang, data[start:]

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = np.frombuffer(text.as_buffer(), dtype=np.uint8)
            held.setdefault(lang, []).extend((_FOLD[raw], border))
            sizes[lang] = sizes.get(lang, 0) + len(raw)
            if sizes[lang] >= CHUNK:
                yield from cut(lang)
            elif sum(sizes.values()) >= 2 * CHUNK:  # many languages
                yield from cut(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from cut(lang)


def _next_border(data: np.ndarray, start: int) -> int:
    for a in range(start, len(data), CHUNK):
        found = np.flatnonzero(data[a : a + CHUNK] == BORDER)
        if len(found):
            return a + int(found[0])
    return len(data) - 1


def _scan(texts: DataFrame, scan: int, shards: int, held: Broadcast, longest: int) -> DataFrame:
    """Counts of the phrases that are active in this scan of one shard; since: the phrase's first scan.

    held: the slot tables of lengths 1 and up, compressed.
    """

    def rows(lang: str, phrases: pa.Array, since: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(n), ROWS):  # the JVM holds a batch at a time
            yield pa.RecordBatch.from_arrays(
                [
                    pc.binary_join_element_wise(phrases.slice(k, ROWS), pa.scalar(lang), pa.scalar("\n")),
                    pa.array(since[k : k + ROWS].astype(np.int32)), pa.array(n[k : k + ROWS].astype(np.int64)),
                ],
                names=["key", "since", "n"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        active = [np.frombuffer(zlib.decompress(table), dtype=np.uint8) for table in held.value]
        for lang, data in _chunks(batches):
            pieces = Pieces(lang, data)
            for size in range(1, longest + 1):
                at = pieces.starts(size)
                if size == 1:
                    since = np.zeros(len(at), dtype=np.uint8)
                else:
                    began = active[size - 2]
                    since = np.maximum(began[pieces.slots(at, size - 1)], began[pieces.slots(at + 1, size - 1)])
                now = (since <= scan) & (since > scan - shards)
                if now.any():
                    phrases, n, one = pieces.counted(at[now], size)
                    first = since[np.searchsorted(at, one)].astype(np.int32)
                    yield from rows(lang, phrases, first + LAST if size == longest else first, n)
            pieces = at = since = now = None
            pa.default_memory_pool().release_unused()

    part = texts.where(F.col("shard") == scan % shards).select("lang", "text")
    return part.mapInArrow(count, _COUNTS)


def phrase_of(key: str) -> Column:
    return F.substring_index(key, "\n", 1)


def lang_of(key: str) -> Column:
    return F.substr(F.col(key), F.length(phrase_of(key)) + 2)


def of_size(size: int) -> Column:
    """Whether a key's phrase has so many words."""
    return F.size(F.split(phrase_of("key"), " ")) == size


def _reached(counted: DataFrame, size: int) -> np.ndarray:
    """Slots of the phrases of one length in counted, as bits; the driver gets bitmaps of all slots at most."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                own = batch.filter(pc.equal(batch.column(0), lang)).column(1).cast(pa.binary()).to_pylist()
                pieces = Pieces(lang, np.frombuffer(bytes([BORDER]).join(own), dtype=np.uint8))
                found = np.unique(pieces.slots(pieces.starts(size), size)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["slot"])

    found = counted.where(of_size(size)).select(lang_of("key").alias("lang"), phrase_of("key").alias("phrase")).mapInArrow(slots, "slot long")
    maps = found.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    out = np.zeros(1 << SLOT_BITS, dtype=bool)
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(r.bits, dtype=np.uint8), bitorder="little")
        first = (r.bucket - 1) * len(bits) + 1  # bucket 1 begins at value 1
        span = slice(max(first, 0), min(first + len(bits), len(out)))
        out[span] = bits[span.start - first : span.stop - first].astype(bool)
    return out


def count_phrases(
    docs: DataFrame, store: Store, longest: int = 3, threshold: int = 10, shards: int = SHARDS
) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` words with at least ``threshold`` occurrences (lang, size, phrase, n), and all words a language."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "shard", F.pmod(F.xxhash64("text"), F.lit(shards))
    )
    active = [np.full(1 << SLOT_BITS, NEVER, dtype=np.uint8) for _ in range(longest - 1)]
    parts, open_, words, scan, last = [], None, None, 0, shards - 1
    whole = F.col("since") >= LAST
    while scan <= last:
        held = spark.sparkContext.broadcast([zlib.compress(table.tobytes(), 1) for table in active])
        fresh = _scan(texts, scan, shards, held, longest)
        if open_ is not None:
            fresh = fresh.unionByName(open_)
        counted = store.put(fresh.groupBy("key").agg(F.max("since").alias("since"), F.sum("n").alias("n")), "counted")
        held.destroy()
        often = ~whole & (F.col("n") >= threshold)
        if scan == shards - 1:
            single = counted.where(~whole & of_size(1)).groupBy(lang_of("key").alias("lang"))
            words = store.put(single.agg(F.sum("n").alias("words")), "words")
        for size in range(1, longest):
            first = _reached(counted.where(often), size) & (active[size - 1] == NEVER)
            active[size - 1][first] = scan + 1
            if first.any():
                last = max(last, scan + shards)
        over = F.col("since") + shards - 1 <= scan
        # phrases of the last length activate nothing, so their sums wait for the end instead of going round
        parts.append(counted.where(whole | (over & often)).select("key", "n"))
        open_ = counted.where(~whole & ~over)
        scan += 1
        if scan >= NEVER:
            raise ValueError("too many scans for the slot tables")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    summed = out.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= threshold)
    found = summed.select(lang_of("key").alias("lang"), phrase_of("key").alias("phrase"), "n")
    return store.put(found.withColumn("size", F.size(F.split("phrase", " "))), "phrases"), words


def mine_phrases(
    docs: DataFrame, longest: int = 3, threshold: int = 10, covered: int = 50, scale: int = 1_000_000, first: int = 2000,
    shards: int = SHARDS,
) -> DataFrame:
    """The highest-scoring phrases of each language: lang, rank, phrase, a, l, r, n, score.

    docs has lang (null: ``und``) and text (null: empty). A phrase of 2 to ``longest`` words with a >= threshold occurrences
    scores floor(scale * a * a / (l * r)) at its lowest-scoring cut, ties to the first; it goes if a longer one that
    contains it has at least ``covered`` percent of its occurrences. Numbers up to 10**15 occurrences are exact. Repeated
    rows count each; a language without a phrase has no row, and so has an empty table. Other columns are not read.
    """
    store = Store(docs.sparkSession, "phrases")
    found, words = count_phrases(docs, store, longest, threshold, shards)
    of = found.select("lang", F.col("phrase").alias("part"), F.col("n").alias("m"))
    held = found.where("size > 1").withColumn("w", F.split("phrase", " "))
    cuts = held.select(
        "lang", "phrase", "size", F.col("n").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).select(
        "lang", "phrase", "size", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    both = (
        cuts.join(of.select("lang", F.col("part").alias("head"), F.col("m").alias("l")), ["lang", "head"])
        .join(of.select("lang", F.col("part").alias("tail"), F.col("m").alias("r")), ["lang", "tail"])
    )
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    exact = F.expr(f"cast({scale} as decimal(7, 0)) * ({wide('a')} * {wide('a')}) div ({wide('l')} * {wide('r')})")
    scored = (
        both.withColumn("score", exact).groupBy("lang", "phrase", "size", "a")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("low")).select("lang", "phrase", "size", "a", "low.score", "low.l", "low.r")
    )
    inner = held.select(
        "lang", F.col("n").alias("longer"), "w", "size", F.explode(F.sequence(F.lit(2), F.greatest(F.col("size") - 1, F.lit(2)))).alias("m")
    ).where("m < size").select(
        "lang", "longer", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")
    ).select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "longer")
    cover = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = (
        scored.join(cover, ["lang", "phrase"], "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    )
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= first)
    return top.join(words.select("lang", F.col("words").alias("n")), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score")
    )


PHRASE_SQL = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
runs AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
spans AS (
    SELECT lang, size, array_to_string(w[place : place + size - 1], ' ') AS phrase
    FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS place FROM runs, range(1, 4) s(size))),
f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS n FROM spans GROUP BY ALL),
held AS (SELECT lang, size, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND n >= 10),
parts AS (
    SELECT lang, phrase, size, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
    FROM held, (VALUES (1), (2)) c(k) WHERE k < size),
cuts AS (
    SELECT p.lang, p.phrase, p.size, p.a, p.k, l.n AS l, r.n AS r, (1000000 * p.a * p.a) // (l.n * r.n) AS score
    FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = p.head JOIN f r ON r.lang = p.lang AND r.phrase = p.tail),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
cover AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM held WHERE size = 3)
    GROUP BY ALL),
ranked AS (
    SELECT low.*, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
    FROM low LEFT JOIN cover USING (lang, phrase) WHERE longer IS NULL OR size = 3 OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, t.n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN (SELECT lang, sum(n) AS n FROM f WHERE size = 1 GROUP BY lang) t USING (lang) WHERE rank <= 2000"""
