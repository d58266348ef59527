"""Removal of byte strings of LENGTH bytes that also start earlier, with suffix arrays over shards of candidate passages.

Suffix arrays of whole shards would have to be merged pairwise, which grows with the square of the shards. So passages
that can hold a repeat are brought together first, exactly. In each window of LENGTH bytes one anchor, the byte run of GRAM
bytes with the smallest hash, is chosen by content alone, so equal windows have equal anchors at equal offsets. Successive
windows with the same anchor form one context (their joint bytes, below 2 * LENGTH). Then:

* equal contexts: all but the first are later copies as a whole (collapsed in the tasks already, before any shuffle);
* different contexts of one anchor meet in one shard, where a suffix array (Larsson-Sadakane refinement in numpy) and
  common prefixes (Kasai's pass, over all contexts at once) give the intervals of equal windows;
* anchors that more than one in HOT_SHARE of all contexts have (at most that many) would fill a shard: their windows are
  named one by one and spread over all tasks instead, and merged by name.

Equality of anchors, contexts and named windows is that of hashes with 64 bits each, two of them together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store, with_row
from codefootprint.llm.words import Rolling, mixed

LENGTH = 100
GRAM = 24
HOT_SHARE = 2000
#: Occurrences in one chunk of texts from which an anchor is counted as a candidate for the hot ones.
LOCALLY_HOT = 8
#: Bytes of texts that a task handles at once, and bytes of contexts in one suffix array.
CHUNK_BYTES = 8 << 20
SHARD_BYTES = 1 << 20

_OUT = "kind int, x long, y long, doc_id long, row_ long, p long, q long"
SPAN, CONTEXT, WINDOW = 0, 1, 2


def anchors(data: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor place and hash, first and last window start of every context of a text."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty, empty
    at = np.arange(len(data) - GRAM + 1)
    h = rolling.spans(at, at + GRAM)
    bits = np.uint64(max(1, int(len(at)).bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while 2 * reach <= width:
        key = np.minimum(key[:-reach], key[reach:])
        reach *= 2
    if reach < width:
        key = np.minimum(key[: n], key[width - reach : width - reach + n])
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], n) - 1
    return place[first], h[place[first]], first, last


def _batch(kind: int, x, y, doc_id, row, p, q) -> pa.RecordBatch:
    n = len(row)
    signed = lambda v: pa.array(np.asarray(v).astype(np.uint64).view(np.int64)) if np.asarray(v).dtype == np.uint64 else pa.array(v, pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), signed(x), signed(y), pa.array(doc_id, pa.int64()), *(pa.array(np.asarray(v, dtype=np.int64)) for v in (row, p, q))],
        names=["kind", "x", "y", "doc_id", "row_", "p", "q"],
    )


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """(doc_id, row_, bytes) of texts, CHUNK_BYTES at a time."""
    held, size = [], 0
    for batch in batches:
        for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            held.append((doc_id, row, data))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _contexts(chunk) -> tuple[np.ndarray, ...]:
    """doc index in the chunk, hash, context hash, first and last window start of all contexts of a chunk."""
    parts = []
    for k, (_, _, data) in enumerate(chunk):
        data = np.frombuffer(data, dtype=np.uint8)
        if len(data) < LENGTH:
            continue
        rolling = Rolling(data)
        place, h, first, last = anchors(data, rolling)
        with np.errstate(over="ignore"):
            context = mixed(rolling.spans(first, last + LENGTH) + (place - first).astype(np.uint64))
        parts.append((np.full(len(h), k), h, context, first, last))
    if not parts:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    return tuple(np.concatenate(c) for c in zip(*parts))


def _order(doc_ids: list, rows: list) -> np.ndarray:
    """Position of each row in the order of doc_id (null first) and row."""
    order = sorted(range(len(rows)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0, rows[i]))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


def _first_of_each(keys: tuple[np.ndarray, ...], order: tuple[np.ndarray, ...]) -> np.ndarray:
    """Mask of the rows that come first, in the given order, among those with equal keys."""
    by = np.lexsort((*reversed(order), *reversed(keys)))
    new = np.ones(len(by), dtype=bool)
    new[1:] = np.any([k[by[1:]] != k[by[:-1]] for k in keys], axis=0)
    mask = np.zeros(len(by), dtype=bool)
    mask[by[new]] = True
    return mask


def hot_anchors(store: Store, rows: DataFrame) -> list[int]:
    """Hashes of the anchors of more than one in HOT_SHARE of all contexts; at most HOT_SHARE of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            _, h, _, _, _ = _contexts(chunk)
            keys, n = np.unique(h, return_counts=True)
            often = n >= LOCALLY_HOT
            keys, n = keys[often].view(np.int64), n[often]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, 0)), pa.array(np.append(n, 0)), pa.array(np.append(np.zeros(len(n), np.int64), len(h)))], names=["h", "n", "total"])

    counted = rows.select("doc_id", "row_", "text").mapInArrow(count, "h long, n long, total long")
    counted = store.put(counted.groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "often")
    least = max(1000, (counted.agg(F.sum("total")).first()[0] or 0) // HOT_SHARE)
    return sorted(r.h for r in counted.where(F.col("n") > least).collect())


def find_contexts(rows: DataFrame, hot: list[int]) -> DataFrame:
    """Rows of _OUT from one pass over the texts.

    SPAN: bytes p to q of row_ are a later copy. CONTEXT: x anchor, y context, p first and q last window start. WINDOW:
    x and y name a window of a hot anchor that starts at p. Of equal contexts or windows in a chunk only the first goes on.
    """
    held = rows.sparkSession.sparkContext.broadcast(np.array(sorted(hot), dtype=np.int64).view(np.uint64))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.sort(held.value)
        for chunk in _chunks(batches):
            doc, h, context, first, last = _contexts(chunk)
            if not len(h):
                continue
            ids, row = [c[0] for c in chunk], [c[1] for c in chunk]
            rank, row = _order(ids, row), np.array(row, dtype=np.int64)
            new = _first_of_each((h, context), (rank[doc], first))
            old = ~new
            yield _batch(SPAN, [0] * int(old.sum()), [0] * int(old.sum()), [ids[d] for d in doc[old]], row[doc[old]], first[old], last[old] + LENGTH)
            is_hot = np.isin(h, hot) if len(hot) else np.zeros(len(h), dtype=bool)
            cold = new & ~is_hot
            yield _batch(CONTEXT, h[cold], context[cold], [ids[d] for d in doc[cold]], row[doc[cold]], first[cold], last[cold])
            if (new & is_hot).any():
                names = ([], [], [], [])
                for k in np.unique(doc[new & is_hot]):
                    mine = np.flatnonzero(new & is_hot & (doc == k))
                    starts = np.concatenate([np.arange(first[i], last[i] + 1) for i in mine])
                    rolling = Rolling(np.frombuffer(chunk[k][2], dtype=np.uint8))
                    names[0].append(rolling.spans(starts, starts + LENGTH))
                    names[1].append(mixed(rolling.spans(starts, starts + LENGTH // 2)) ^ rolling.spans(starts + 7, starts + LENGTH))
                    names[2].append(np.full(len(starts), k))
                    names[3].append(starts)
                x, y, d, p = (np.concatenate(c) for c in names)
                new = _first_of_each((x, y), (rank[d], p))
                old = ~new
                yield _batch(SPAN, [0] * int(old.sum()), [0] * int(old.sum()), [ids[i] for i in d[old]], row[d[old]], p[old], p[old] + LENGTH)
                yield _batch(WINDOW, x[new], y[new], [ids[i] for i in d[new]], row[d[new]], p[new], p[new] + LENGTH)

    return rows.select("doc_id", "row_", "text").mapInArrow(find, _OUT)


def _whole_keys(batches: Iterator[pa.RecordBatch], column: int, least: int) -> Iterator[pa.RecordBatch]:
    """Batches cut anew: no key of the sorted column is in two of them; each has ``least`` rows where the keys allow."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(column).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut)
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def sort_contexts(contexts: DataFrame) -> DataFrame:
    """From CONTEXT rows: SPAN rows of later copies, and CONTEXT rows of the first of each kind, where kinds share an anchor."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 1, 20_000):
            h, y, row, p, q = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5, 6))
            # rows come ordered by anchor, doc_id, row and place, so positions in the batch are the order
            new = _first_of_each((h, y), (np.arange(len(h)),))
            group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
            several = np.bincount(group, weights=new)[group] > 1
            old = pa.array(np.flatnonzero(~new))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(old), SPAN, np.int32)), *(batch.column(i).take(old) for i in (1, 2, 3, 4, 5)), pa.array(q[~new] + LENGTH)],
                names=batch.schema.names,
            )
            on = pa.array(np.flatnonzero(new & several))
            yield pa.RecordBatch.from_arrays([c.take(on) for c in batch.columns], names=batch.schema.names)

    return contexts.repartition("x").sortWithinPartitions("x", "doc_id", "row_", "p").mapInArrow(sort, _OUT)


def suffix_array(keys: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` bytes or more; keys: 8 bytes at each place, ends: end of its context.

    Larsson-Sadakane: groups that agree in the first h bytes are refined by the ranks h places on; h doubles, and places
    alone in their group are left out from then on.
    """
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order[1:]] != keys[order[:-1]]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 8
    while h < depth:
        size = np.bincount(rank, minlength=n)
        slots = np.flatnonzero(size[rank[order]] > 1)
        if not len(slots):
            break
        places = order[slots]
        behind = places + h
        inside = behind < ends[places]
        second = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.lexsort((second, rank[places]))
        places, second = places[by], second[by]
        order[slots] = places
        first = rank[places]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[places] = slots[np.flatnonzero(new)[np.cumsum(new) - 1]]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """For each place the common prefix, up to ``cap``, with the place before it in the order.

    Kasai's pass, one step for all contexts at once: a place's prefix is at most one shorter than that of the place to its
    left, so each step goes on from there.
    """
    n = len(data)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    out = np.zeros(n, dtype=np.int64)
    lengths = ends[starts] - starts
    now = np.zeros(len(starts), dtype=np.int64)
    for j in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > j)
        i = starts[live] + j
        p = before[i]
        limit = np.where(p >= 0, np.minimum(np.minimum(ends[i] - i, ends[p] - p), cap), 0)
        length = np.minimum(np.maximum(now[live] - 1, 0), limit)
        todo = np.flatnonzero(length + 8 <= limit)
        while len(todo):
            todo = todo[keys[i[todo] + length[todo]] == keys[p[todo] + length[todo]]]
            length[todo] += 8
            todo = todo[length[todo] + 8 <= limit[todo]]
        todo = np.flatnonzero(length < limit)
        while len(todo):
            todo = todo[data[i[todo] + length[todo]] == data[p[todo] + length[todo]]]
            length[todo] += 1
            todo = todo[length[todo] < limit[todo]]
        out[i] = length
        now[live] = length
    return out


def repeated_starts(texts: list[bytes], cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the strings of ``cap`` bytes that also stand in an earlier text of the list, at any place there.

    Each string stands in a text only once, as contexts are made.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths)
    starts = stops - lengths
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    owner = np.repeat(np.arange(len(texts)), lengths)
    ends = stops[owner]
    padded = np.append(data, np.zeros(8, dtype=np.uint8)).astype(np.uint64)
    keys = np.zeros(len(data), dtype=np.uint64)
    left = ends - np.arange(len(data))
    for k in range(8):
        keys |= np.where(left > k, padded[k : len(data) + k], 0) << np.uint64(56 - 8 * k)
    # to the contexts' full length: Kasai's step needs the true order, and equal suffixes in order of place
    order = suffix_array(keys, ends, int(lengths.max(initial=1)))
    common = common_prefixes(data, keys, starts, ends, order, cap)[order]
    long = left[order] >= cap
    interval = np.cumsum(common < cap)
    order, interval = order[long], interval[long]
    if not len(order):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
    earliest = np.minimum.reduceat(owner[order], begin)
    sizes = np.diff(np.append(begin, len(order)))
    later = order[owner[order] > np.repeat(earliest, sizes)]
    later.sort()
    return owner[later], later - starts[owner[later]]


def compare_contexts(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """SPAN rows from CONTEXT rows of several kinds an anchor: windows that also stand in an earlier context."""
    lists = contexts.groupBy("row_").agg(F.collect_list(F.struct("x", "p", "q")).alias("parts"))
    joined = rows.join(lists, "row_").select("doc_id", "row_", "text", "parts")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("x", pa.int64()), ("doc_id", pa.int64()), ("row_", pa.int64()), ("p", pa.int64()), ("data", pa.binary())])
        for batch in batches:
            for low in range(0, batch.num_rows, 128):
                out: list[list] = [[], [], [], [], []]
                for doc_id, row, text, parts in zip(*(c.to_pylist() for c in batch.slice(low, 128).columns)):
                    data = text.encode("utf-8", "surrogatepass")
                    for part in parts:
                        for column, value in zip(out, (part["x"], doc_id, row, part["p"], data[part["p"] : part["q"] + LENGTH])):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_keys(batches, 0, SHARD_BYTES // (LENGTH + LENGTH // 2)):
            # rows come ordered by anchor, doc_id, row and place; a string has one anchor, so list order is text order
            owner, place = repeated_starts(batch.column(4).to_pylist())
            if len(owner):
                row, p = (batch.column(i).to_numpy() for i in (2, 3))
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)])
                begin = np.flatnonzero(new)
                stop = np.append(begin[1:], len(owner)) - 1
                who = owner[begin]
                zeros = [0] * len(begin)
                yield _batch(SPAN, zeros, zeros, batch.column(1).take(pa.array(who)), row[who], p[who] + place[begin], p[who] + place[stop] + LENGTH)

    spelled = joined.mapInArrow(spell, "x long, doc_id long, row_ long, p long, data binary")
    return spelled.repartition("x").sortWithinPartitions("x", "doc_id", "row_", "p").mapInArrow(compare, _OUT)


def merge_windows(store: Store, windows: DataFrame) -> DataFrame:
    """SPAN rows from WINDOW rows: all but the first window of a name."""
    windows = store.put(windows.select("x", "y", "doc_id", "row_", "p", "q"), "windows")
    firsts = windows.groupBy("x", "y").agg(F.min(F.struct("doc_id", "row_", "p")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = store.put(firsts.select("x", "y", F.col("first.row_").alias("row0"), F.col("first.p").alias("p0")), "firsts")
    return windows.join(firsts, ["x", "y"]).where("row_ != row0 or p != p0").select("row_", "p", "q")


def repeated_spans(store: Store, rows: DataFrame) -> DataFrame:
    """row_, p, q: byte spans that are covered by strings of LENGTH bytes that also start earlier (spans may overlap)."""
    hot = hot_anchors(store, rows)
    found = store.put(find_contexts(rows, hot), "contexts")
    sorted_ = store.put(sort_contexts(found.where(F.col("kind") == CONTEXT)), "kinds")
    compared = store.put(compare_contexts(rows, sorted_.where(F.col("kind") == CONTEXT)).select("row_", "p", "q"), "compared")
    spans = found.where(F.col("kind") == SPAN).select("row_", "p", "q").unionByName(
        sorted_.where(F.col("kind") == SPAN).select("row_", "p", "q")
    ).unionByName(compared)
    if hot:
        spans = spans.unionByName(merge_windows(store, found.where(F.col("kind") == WINDOW)))
    return spans


def remove_spans(text: str | None, spans) -> tuple[int, int, int, str, bytes]:
    """Bytes of the text, bytes removed, runs removed, digest of the rest, the rest."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    borders = np.zeros(len(data) + 1, dtype=np.int64)
    if spans is not None and len(spans):
        np.add.at(borders, [s["p"] for s in spans], 1)
        np.add.at(borders, [s["q"] for s in spans], -1)
    gone = np.cumsum(borders[:-1]) > 0
    rest = data[~gone].tobytes()
    runs = int(np.count_nonzero(gone & ~np.concatenate([[False], gone[:-1]]))) if len(gone) else 0
    return len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest(), rest


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, rest (the bytes left) of every whole text.

    docs: doc_id, text, in a stored table (it is read more than once and must read the same). A byte goes if a string of
    LENGTH bytes over it also starts earlier: in a smaller doc_id (null first; of rows with one id, the earlier row), or
    earlier in the same text. Null is an empty text; texts below LENGTH bytes lose nothing; an empty table gives no rows.
    The rest of a text may be no valid UTF-8 and so is binary.
    """
    store = Store(docs.sparkSession, "substrings")
    rows = with_row(docs.select("doc_id", "text"))
    spans = repeated_spans(store, rows).groupBy("row_").agg(F.collect_list(F.struct("p", "q")).alias("spans"))
    marked = rows.join(spans, "row_", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, rest binary")
    def remove(texts, spans):
        import pandas as pd

        return pd.DataFrame([remove_spans(t, s) for t, s in zip(texts, spans)], columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "rest"])

    return marked.select("doc_id", remove("text", "spans").alias("r")).select("doc_id", "r.*")
