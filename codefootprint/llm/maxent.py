"""Hashed maximum-entropy language model with a class-factored softmax, trained by distributed gradient updates.

A token's probability is P(class | history) P(token | class, history). The most frequent training tokens stand in classes
of CLASS_WORDS tokens with a softmax of their own; all others stand in classes by their spelling (last byte and length),
within which they have their smoothed relative frequency. Both softmax layers are log-linear in hashed features of the
history: the words one and two back, both together (n-grams) and the words three and five back alone (skips), and a bias.

The counts behind a rare token's share are joined to it by Spark, as the vocabulary may have any size; only the HEAD most
frequent tokens and the weights (fixed sizes) are broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store

#: Tokens with a count in every task, and those of them with a place in a softmax of their own.
HEAD = 1 << 15
CLASS_WORDS = 32
WORD_CLASSES = 16
SPELLING_CLASSES = 48
CLASSES = WORD_CLASSES + SPELLING_CLASSES
FEATURE_BUCKETS = 1 << 13
#: Tokens of a bucket, within a step, up to which their gradients are added beside those of other buckets.
FEW = 8
#: Rounds of training over all training texts; in each, every STRIDE-th token of a text gives a gradient, so that over the
#: rounds every token gives one.
ROUNDS = 2
STRIDE = 2
#: Tasks of a round: as many as the texts have splits up to WORKERS, beyond that one for every SPLITS splits. Their weights
#: are averaged in levels, FAN of them at a time.
WORKERS = 32
SPLITS = 8
FAN = 32
RATE = 0.5
MINIBATCH = 2048
#: Texts whose tokens a task looks up at a time, and their bytes at most (or one text); rows of counts that it adds up at a time.
CHUNK_TEXTS = 256
CHUNK_BYTES = 1 << 22
COUNT_ROWS = 2_000_000
END = b"\n"
SMOOTHING = 0.1
FEATURES = 5
#: Tokens before a text, one for each place that a feature looks back. No word is empty.
LOOKS_BACK = (1, 2, 3, 5)
NO_HISTORY = np.zeros(max(LOOKS_BACK), np.int64)
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
SOLID = np.array([not bytes([b]).isspace() for b in range(256)])


def tokens_of(text: str | None) -> list[bytes]:
    """Words of the whole text with A-Z in lower case, and one end."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def tokens_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """What ``tokens_of`` gives for each text, one after the other in one binary array, and how many are each text's."""
    texts = texts.cast(pa.binary()).fill_null(b"")
    n = len(texts)
    borders = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = LOWER[np.frombuffer(data, np.uint8)[borders[0] : borders[-1]]] if data is not None else LOWER[:0]
    borders -= borders[0]
    solid = SOLID[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edges = borders[:-1][borders[:-1] < len(raw)]
    begins[edges] = solid[edges]
    at = np.flatnonzero(begins)
    before = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    words, ends = np.searchsorted(at, borders), before[borders[1:]]
    lengths = np.diff(words)
    body = np.insert(raw[solid], ends, END[0])
    low = np.insert(before[at] + np.repeat(np.arange(n), lengths), words[1:], ends + np.arange(n))
    offsets = np.append(low, len(body)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(offsets), pa.py_buffer(body)]), lengths + 1


def chunks_of(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Runs of up to CHUNK_TEXTS texts with up to CHUNK_BYTES bytes, or of one text, each with the place of its first."""
    sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(texts):
        fitting = int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + CHUNK_BYTES, "right")) - low
        n = max(1, min(fitting, CHUNK_TEXTS))
        yield low, texts.slice(low, n)
        low += n


def spelling_class(token: bytes) -> int:
    return WORD_CLASSES + (token[-1] * 7 + (len(token) > 6) + 2 * (len(token) > 10)) % SPELLING_CLASSES


def _logits(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows' features less their largest, a feature at a time, so that what is summed stays in the cache."""
    x = table.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        x += table.take(rows[:, k], axis=0)
    x -= x.max(axis=1, keepdims=True)
    return x


def sums_by_bucket(rows: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets that stand in ``rows`` (one row per token), the sums of their tokens' gradients, and how many those are.

    Most buckets have few tokens: up to FEW they are added for all buckets at once, one token of each at a time. Only the
    others go through numpy's reduction, which is slow on short runs; they come first, the rest by falling number of tokens.
    """
    flat = rows.astype(np.uint16).ravel()
    order = np.argsort(flat, kind="stable")
    held, source = flat[order], order // rows.shape[1]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    n = np.diff(first, append=len(held))
    by = np.argsort(np.minimum(n, FEW + 1).astype(np.uint8), kind="stable")[::-1]
    n, first = n[by], first[by]
    many = np.count_nonzero(n > FEW)
    sums = grad.take(source[first], axis=0)
    rest = grad.take(source[first[many : np.count_nonzero(n > 1)] + 1], axis=0)
    for k in range(2, FEW):
        some = first[many : np.count_nonzero(n > k)]
        rest[: len(some)] += grad.take(source[some + k], axis=0)
    sums[many : many + len(rest)] += rest
    if many:
        starts = np.cumsum(n[:many]) - n[:many]
        at = np.arange(n[:many].sum()) + np.repeat(first[:many] - starts, n[:many])
        sums[:many] = np.add.reduceat(grad.take(source[at], axis=0), starts, axis=0)
    return held[first].astype(np.int64), sums, n


@dataclass
class HeadTable:
    """What tasks know of the frequent tokens, and the sums of all training counts."""

    counts: dict[bytes, int]
    places: dict[bytes, int]
    total: int
    kinds: int
    class_total: np.ndarray
    class_kinds: np.ndarray

    def codes(self) -> Codes:
        return Codes({t: (i, self.places.get(t)) for i, t in enumerate(self.counts)})


def hashes_of(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, tokens), np.int64, len(tokens))


class Codes:
    """What tasks look up for a token, in one number: its hash (32 bits), class or place (10 bits; a place p of a frequent
    token is CLASSES + p), and above them the number among the HEAD most frequent tokens (HEAD for all others)."""

    def __init__(self, head: dict[bytes, tuple[int, int | None]]):
        kinds = [i << 10 | (spelling_class(t) if p is None else CLASSES + p) for t, (i, p) in head.items()]
        self._head, self._codes = pa.array(head, pa.binary()), np.array(kinds, np.int64) << 32 | hashes_of([*head])

    def of(self, tokens: pa.Array) -> np.ndarray:
        found = pc.index_in(tokens, self._head)
        out = np.empty(len(tokens), np.int64)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        out[known] = self._codes[found.drop_null().to_numpy()]
        rare = np.flatnonzero(~known)
        if len(rare):
            words = tokens.take(pa.array(rare))
            ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
            data, lengths = words.buffers()[2].to_pybytes(), np.diff(ends)
            last = np.frombuffer(data, np.uint8)[ends[1:] - 1].astype(np.int64)
            kinds = WORD_CLASSES + (last * 7 + (lengths > 6) + 2 * (lengths > 10)) % SPELLING_CLASSES
            cut = ends.tolist()
            out[rare] = (HEAD << 10 | kinds) << 32 | hashes_of([data[a:b] for a, b in zip(cut, cut[1:])])
        return out


def kinds_of(codes: np.ndarray) -> np.ndarray:
    return codes >> 32 & 1023


def token_hashes(codes: np.ndarray) -> np.ndarray:
    return codes & 0xFFFFFFFF


def feature_rows(hashes: np.ndarray) -> np.ndarray:
    """Feature buckets of each token's history in one text, FEATURES a token; places before the text count as one token."""
    padded = np.concatenate([NO_HISTORY, hashes])
    return history_rows(*(padded[len(NO_HISTORY) - k :][: len(hashes)] for k in LOOKS_BACK))


def history_rows(one: np.ndarray, two: np.ndarray, three: np.ndarray, five: np.ndarray) -> np.ndarray:
    """Feature buckets, FEATURES a token, from the hashes of the tokens that many places back (LOOKS_BACK)."""
    raw = (np.zeros(len(one), dtype=np.int64), one * 3 + 1, (one * 31 + two) * 3 + 2, two * 5 + 7, (three ^ (five << 1)) * 11 + 5)
    out = np.empty((len(one), FEATURES), dtype=np.int64)
    for i, r in enumerate(raw):
        h = (r.astype(np.uint64) + np.uint64(i)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = (h >> np.uint64(64 - FEATURE_BUCKETS.bit_length() + 1)).astype(np.int64)
    return out


class Weights:
    """Both layers: class scores by feature, and scores of a class's words by feature (mixed with the class)."""

    def __init__(self, classes: np.ndarray, words: np.ndarray):
        self.classes, self.words = classes, words

    @staticmethod
    def start() -> Weights:
        return Weights(np.zeros((FEATURE_BUCKETS, CLASSES), np.float32), np.zeros((FEATURE_BUCKETS, CLASS_WORDS), np.float32))

    @staticmethod
    def word_rows(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        return (rows * 31 + kinds[:, None] * 977 + 13) % FEATURE_BUCKETS

    def log_probability(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Natural log of P(class) and, for tokens with a place, of P(token | class), a token."""
        out = np.empty(len(ids))
        place = ids - CLASSES
        kinds = np.where(place >= 0, place // CLASS_WORDS, ids)
        for a in range(0, len(ids), MINIBATCH):
            part = slice(a, a + MINIBATCH)
            out[part] = self._log_share(self.classes, rows[part], kinds[part])
        at = np.flatnonzero(place >= 0)
        for a in range(0, len(at), MINIBATCH):
            some = at[a : a + MINIBATCH]
            out[some] += self._log_share(self.words, self.word_rows(rows[some], kinds[some]), place[some] % CLASS_WORDS)
        return out

    @staticmethod
    def _log_share(table: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        x = _logits(table, rows)
        own = x[np.arange(len(x)), wanted]
        return own - np.log(np.exp(x, out=x) @ np.ones(x.shape[1], np.float32))

    def update(self, ids: np.ndarray, rows: np.ndarray, rate: float) -> None:
        """One gradient step on the tokens' log-likelihood."""
        place = ids - CLASSES
        kinds = np.where(place >= 0, place // CLASS_WORDS, ids)
        self._step(self.classes, rows, kinds, rate)
        at = np.flatnonzero(place >= 0)
        if len(at):
            self._step(self.words, self.word_rows(rows[at], kinds[at]), place[at] % CLASS_WORDS, rate)

    @staticmethod
    def _step(table: np.ndarray, rows: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        grad = _logits(table, rows)
        np.exp(grad, out=grad)
        grad /= -grad.sum(axis=1, keepdims=True)
        grad[np.arange(len(wanted)), wanted] += 1
        keys, sums, n = sums_by_bucket(rows, grad)
        # a bucket's step is its mean gradient, less where fewer than four tokens agree on it
        sums *= np.float32(rate / 4)
        more = np.count_nonzero(n > 4)
        sums[:more] /= (n[:more] / 4).astype(np.float32)[:, None]
        sums += table.take(keys, axis=0)
        table[keys] = sums


def gradient_places(tokens: list[bytes], number: int, stride: int = STRIDE) -> np.ndarray:
    """Places of the tokens that give a gradient in a round; any ``stride`` rounds in a row have all of them."""
    return places_after(zlib.crc32(tokens[0]), len(tokens), number, stride)


def places_after(first: int, length: int, number: int, stride: int) -> np.ndarray:
    """gradient_places of a text by its first token's hash and its number of tokens."""
    return np.arange((first + number) % stride, length, stride)


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (binary), c: how often each token stands in the texts; partial sums leave the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def pack() -> list[pa.RecordBatch]:
            return pa.concat_tables(held).group_by("token", use_threads=False).aggregate([("c", "sum")]).rename_columns(["token", "c"]).to_batches()

        for batch in batches:
            for _, texts in chunks_of(batch.column(0)):
                counts = tokens_in(texts)[0].value_counts()
                held.append(pa.table({"token": counts.field("values"), "c": counts.field("counts")}))
                rows += len(counts)
                if rows > COUNT_ROWS:
                    yield from pack()
                    held, rows = [], 0
        if held:
            yield from pack()

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def head_table(counts: DataFrame) -> HeadTable:
    """The HEAD most frequent tokens and the sums; the driver gets HEAD rows and one row per class."""
    head = counts.orderBy(F.desc("c"), "token").limit(HEAD).collect()
    total, kinds = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    table = HeadTable({bytes(r.token): r.c for r in head}, {}, int(total or 0), int(kinds), np.zeros(CLASSES), np.zeros(CLASSES))
    table.places = {bytes(r.token): i for i, r in enumerate(head[: WORD_CLASSES * CLASS_WORDS])}
    last = F.conv(F.hex(F.expr("substring(token, -1, 1)")), 16, 10).cast("int")
    n = F.length("token")
    spelled = F.lit(WORD_CLASSES) + (last * 7 + (n > 6).cast("int") + 2 * (n > 10).cast("int")) % SPELLING_CLASSES
    for r in counts.groupBy(spelled.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():
        table.class_total[r.k], table.class_kinds[r.k] = r.c, r.n
    for token, place in table.places.items():
        table.class_total[spelling_class(token)] -= table.counts[token]
        table.class_kinds[spelling_class(token)] -= 1
    return table


def train(docs: DataFrame, head: HeadTable, rounds: int = ROUNDS, stride: int = STRIDE) -> Weights:
    """Weights after rounds in which each task descends over its share of the texts.

    The tasks start a round from the same weights and return theirs in blocks, which Spark averages, weighted by tokens.
    Tasks grow with the input, and no group has more than FAN blocks. The driver holds one copy of the weights
    (FEATURE_BUCKETS rows).
    """
    spark = docs.sparkSession
    splits = docs.rdd.getNumPartitions()
    workers = min(splits, max(WORKERS, splits // SPLITS))
    weights, codes = Weights.start(), head.codes()
    block = 256
    for number in range(rounds):
        held = spark.sparkContext.broadcast((codes, weights))

        def descend(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            codes, start = held.value
            own = Weights(start.classes.copy(), start.words.copy())
            waiting_codes, places, size, waiting, n = [], [], 0, 0, 0

            def step() -> None:
                nonlocal size, waiting, n
                at, found = np.concatenate(places), np.concatenate(waiting_codes)
                hashes = token_hashes(found)
                own.update(kinds_of(found[at]), history_rows(*(hashes[at - k] for k in LOOKS_BACK)), RATE / (1 + number))
                n += waiting
                size = waiting = 0
                waiting_codes.clear()
                places.clear()

            for batch in batches:
                for _, texts in chunks_of(batch.column(0)):
                    tokens, lengths = tokens_in(texts)
                    found = codes.of(tokens)
                    ends = np.cumsum(lengths)
                    firsts = token_hashes(found[ends - lengths])
                    for first, length, end in zip(firsts.tolist(), lengths.tolist(), ends.tolist()):
                        at = places_after(first, length, number, stride)
                        if len(at):
                            places.append(at + size + len(NO_HISTORY))
                            waiting_codes += [NO_HISTORY, found[end - length : end]]
                            size += len(NO_HISTORY) + length
                            waiting += len(at)
                        if waiting >= MINIBATCH:
                            step()
            if waiting:
                step()
            if n:
                both = np.hstack([own.classes, own.words])
                parts = range(0, FEATURE_BUCKETS, block)
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_pydict({
                    "at": list(parts), "task": [task] * len(parts), "n": [n] * len(parts), "data": [(both[a : a + block] * np.float32(n)).tobytes() for a in parts],
                })

        def add(key, table):
            n = sum(table.column("n").to_pylist())
            total = sum(np.frombuffer(d.as_buffer(), dtype=np.float32).astype(np.float64) for d in table.column("data"))
            return pa.table({"at": [key[0].as_py()], "task": [key[1].as_py()], "n": [n], "data": [total.astype(np.float32).tobytes()]})

        blocks, left = docs.select("text").coalesce(max(1, workers)).mapInArrow(descend, "at long, task long, n long, data binary"), workers
        while left > 1:
            left = -(-left // FAN)
            blocks = blocks.withColumn("task", F.col("task") % left).groupBy("at", "task").applyInArrow(add, "at long, task long, n long, data binary")
        for r in blocks.collect():
            both = (np.frombuffer(bytes(r.data), dtype=np.float32) / np.float32(r.n)).reshape(-1, CLASSES + CLASS_WORDS)
            weights.classes[r["at"] : r["at"] + block] = both[:, :CLASSES]
            weights.words[r["at"] : r["at"] + block] = both[:, CLASSES:]
        held.unpersist()
    return weights


def score_texts(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, of every whole text of docs, learned from ``training``.

    base_score is the smoothed unigram log10 probability; score the model's. A token that training does not know has the
    share of one unseen token of its spelling class. Null and empty texts are one end. Repeated rows are scored alike, an
    empty training table leaves smoothing only (base_score is then 0), an empty docs table gives no rows; other columns are
    not read.
    """
    store = Store(docs.sparkSession, "maxent")
    counts = store.put(count_tokens(training), "counts")
    head = head_table(counts)
    weights = train(training, head)
    base_of = np.zeros(HEAD + 1)
    base_of[: len(head.counts)] = np.log10(np.array([*head.counts.values()], dtype=np.float64) + SMOOTHING)
    held = docs.sparkSession.sparkContext.broadcast((head.codes(), base_of, weights))
    log_class = np.log10(head.class_total + SMOOTHING * (head.class_kinds + 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, base_of, weights = held.value
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, texts in chunks_of(batch.column(1)):
                tokens, lengths = tokens_in(texts)
                first = np.cumsum(lengths) - lengths
                found = codes.of(tokens)
                at = np.arange(len(tokens)) + len(NO_HISTORY) * np.repeat(np.arange(1, len(texts) + 1), lengths)
                hashes = np.zeros(len(tokens) + len(NO_HISTORY) * len(texts), np.int64)
                hashes[at] = token_hashes(found)
                rows = history_rows(*(hashes[at - k] for k in LOOKS_BACK))
                ids, number_in_head = kinds_of(found), found >> 42
                logs = weights.log_probability(ids, rows) / np.log(10)
                base = base_of[number_in_head]
                # a token without a place also has a share of its class: (count + smoothing) / class_total
                spelled = ids < CLASSES
                logs[spelled] += base[spelled] - log_class[ids[spelled]]
                known = number_in_head < HEAD
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, logs)]
                keys = (task << 33) + number + np.arange(len(texts))
                number += len(texts)
                rare = np.flatnonzero(~known)
                n, k = len(texts), len(rare)
                whole = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(k, kind)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(keys, np.repeat(keys, lengths)[rare]), pa.int64()),
                        pa.concat_arrays([batch.column(0).slice(low, n), pa.nulls(k, pa.int64())]), whole(lengths, pa.int64()), whole(sums[0], pa.int64()),
                        whole(sums[1], pa.float64()), whole(sums[2], pa.float64()),
                        pa.concat_arrays([pa.nulls(n, pa.binary()), tokens.take(pa.array(rare))]),
                    ],
                    names=["key", "doc_id", "n", "n_known", "base", "model", "token"],
                )

    parts = store.put(
        docs.select("doc_id", "text").mapInArrow(score, "key long, doc_id long, n long, n_known long, base double, model double, token binary"), "parts"
    )
    tail = (
        parts.where("token is not null").select("key", "token")
        .join(counts, "token", "left")
        .withColumn("log", F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING))
        .groupBy("key").agg(F.sum("log").alias("log"), F.count(F.when(F.col("c") > 0, 1)).alias("more"))
    )
    whole = float(np.log10(head.total + SMOOTHING * (head.kinds + 1)))
    added = F.coalesce("log", F.lit(0.0))
    return (
        parts.where("token is null").drop("token").join(tail, "key", "left")
        .select(
            "doc_id", F.col("n").alias("n_tokens"), (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(head.total).cast("long").alias("train_tokens"),
            (F.col("base") + added - F.col("n") * whole).alias("base_score"), (F.col("model") + added).alias("score"),
        )
    )


def score_held_out(docs: DataFrame, folds: int = 10, held_fold: int = 0) -> DataFrame:
    """score_texts over all docs, learned from all but one fold (crc32 of the id), with a column held_out.

    A null doc_id is no row of the held fold.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(False))
    scored = score_texts(docs, docs.where(~held))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
