"""Line deduplication by a suffix array over sequences of line identifiers, built with distributed prefix doubling.

A document is its sequence of lines with a word. Lines that stand only once in the corpus end a sequence, as no repeated
run can hold them. Ranks of the suffixes by their first 1, 2, 4, ... lines come from ranking pairs of the ranks before, so
two suffixes share their first n lines exactly if they agree in the pair of ranks that covers n: such a set of suffixes is
a longest-common-prefix interval of depth n or more. A run of lines of MIN_WORDS words or more that also starts earlier
(smaller doc_id, or earlier in the document) is a later copy and is deleted.

Every deleted line lies in a shortest run of MIN_WORDS words, starting or ending at some line, that is a later copy (a
part of a later copy is one), so intervals of these depths reveal all maximal runs, and doubling may stop at the longest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store, numbered, with_row
from codefootprint.llm.words import WORD_PATTERN

MIN_WORDS = 5


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that no document (column row_, sorted) is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(rows, rows[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != rows[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks().to_batches()[0]
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_document(table: DataFrame, f: Callable, schema: str) -> DataFrame:
    return table.repartition("row_").sortWithinPartitions("row_", "pos").mapInArrow(lambda b: f(whole_documents(b)), schema)


def _sequences(rows: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Number of the unbroken sequence that each line belongs to."""
    broken = np.ones(len(rows), dtype=bool)
    broken[1:] = (rows[1:] != rows[:-1]) | (pos[1:] != pos[:-1] + 1)
    return np.cumsum(broken)


def line_table(docs: DataFrame) -> DataFrame:
    """row_, doc_id, at (place in the text), pos (place among the lines with a word), words, and a 128-bit line identifier."""
    lines = docs.select("row_", "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = lines.withColumn("words", F.regexp_count("line", F.lit(WORD_PATTERN)).cast("long")).where("words > 0")
    return lines.select("row_", "doc_id", "at", "words", F.xxhash64("line").alias("h"), F.xxhash64(F.lit("again"), "line").alias("g"))


def repeated_sequences(store: Store, docs: DataFrame) -> DataFrame:
    """row_, pos, doc_id, at, words, r0: the lines that stand more than once, with their rank among such lines."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False)
            first = np.searchsorted(rows, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(len(rows)) - first)], names=[*batch.schema.names, "pos"])

    # lines leave the split in order, so places among lines with a word need no sort: count the words' lines before
    placed = line_table(docs).repartition("row_").sortWithinPartitions("row_", "at").mapInArrow(
        lambda b: place(whole_documents(b)), "row_ long, doc_id long, at int, words long, h long, g long, pos long"
    )
    lines = store.put(placed, "lines")
    often = lines.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "g")
    often = store.put(numbered(store, often, "r0", "h", "g").withColumn("r0", F.col("r0") + 1), "ranked")
    return store.put(lines.join(often, ["h", "g"]).select("row_", "pos", "doc_id", "at", "words", "r0"), "repeated")


def double_ranks(store: Store, lines: DataFrame, level: int) -> DataFrame:
    """Adds r{level + 1}, the rank by the first 2 ** (level + 1) lines, from r{level}; behind a sequence's end ranks are 0."""
    names, step = lines.columns, 1 << level

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            runs = _sequences(column["row_"], column["pos"])
            rank, behind = column[f"r{level}"], np.zeros(len(runs), dtype=np.int64)
            if len(runs) > step:
                behind[:-step] = np.where(runs[step:] == runs[:-step], rank[step:], 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(behind)], names=[*names, "behind"])

    schema = ", ".join(f"{n} {t}" for n, t in lines.dtypes) + ", behind long"
    paired = store.put(_by_document(lines, pair, schema), "paired")
    pairs = paired.select(F.col(f"r{level}").alias("a"), F.col("behind").alias("b")).distinct()
    ranked = store.put(numbered(store, pairs, "rank", "a", "b"), "ranked")
    joined = paired.join(ranked, (F.col(f"r{level}") == F.col("a")) & (F.col("behind") == F.col("b")))
    return store.put(joined.select(*names, (F.col("rank") + 1).alias(f"r{level + 1}")), "doubled")


def shortest_runs(lines: DataFrame, levels: int, min_words: int) -> DataFrame:
    """row_, doc_id, start, n, x, y: runs of lines that reach ``min_words`` but not without their last or first line.

    x and y are the ranks of the run's first and last 2 ** k lines, for the largest k that fits: with n they name the run.
    """
    names = lines.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
            runs = _sequences(column["row_"], column["pos"])
            ranks = np.stack([column[f"r{k}"] for k in range(levels + 1)])
            sums = np.concatenate([[0], np.cumsum(column["words"])])
            i = np.arange(len(runs))
            end = np.searchsorted(sums, sums[:-1] + min_words) - 1
            start = np.searchsorted(sums, sums[1:] - min_words, side="right") - 1
            fits = (end < len(runs)) & (runs[np.minimum(end, len(runs) - 1)] == runs)
            backs = (start >= 0) & (runs[np.maximum(start, 0)] == runs)
            both = np.unique(np.concatenate([np.stack([i[fits], end[fits]], 1), np.stack([start[backs], i[backs]], 1)]), axis=0)
            first, last = both[:, 0], both[:, 1]
            n = last - first + 1
            k = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(column["row_"][first]), batch.column(names.index("doc_id")).take(pa.array(first)),
                    pa.array(column["pos"][first]), pa.array(n), pa.array(ranks[k, first]), pa.array(ranks[k, last - (1 << k) + 1]),
                ],
                names=["row_", "doc_id", "start", "n", "x", "y"],
            )

    return _by_document(lines, cut, "row_ long, doc_id long, start long, n long, x long, y long")


def later_copies(store: Store, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row_, start, n: runs of lines (places among the lines with a word) that also start earlier. docs: row_, doc_id, text."""
    lines = repeated_sequences(store, docs)
    # a line has a word at least, so no shortest run has more than min_words lines
    levels = max(0, min_words.bit_length() - 1)
    for level in range(levels):
        lines = double_ranks(store, lines, level)
    runs = store.put(shortest_runs(lines, levels, min_words), "runs")
    place = F.struct("doc_id", "row_", "start")
    intervals = runs.groupBy("n", "x", "y").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    intervals = store.put(intervals.select("n", "x", "y", F.col("first.row_").alias("row0"), F.col("first.start").alias("start0")), "intervals")
    copies = runs.join(intervals, ["n", "x", "y"]).where("row_ != row0 or start != start0")
    return store.put(copies.select("row_", "start", "n"), "copies")


def _marked(docs: DataFrame, store: Store, min_words: int) -> DataFrame:
    """docs (with row_) and spans, an array of (start, n) or null."""
    copies = later_copies(store, docs, min_words)
    spans = copies.groupBy("row_").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    # a merge join at every size: the plan, and what it moves, follows the input evenly
    return docs.join(spans.hint("merge"), "row_", "left")


def split_lines(text: str | None, spans) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The text's lines, which of them have a word, and which are deleted."""
    lines = [] if text is None else text.split("\n")
    wordy = np.array([bool(line.strip(" \t\n\x0b\x0c\r")) for line in lines], dtype=bool)
    borders = np.zeros(int(wordy.sum()) + 1, dtype=np.int64)
    for s in spans if spans is not None else ():
        borders[s["start"]] += 1
        borders[s["start"] + s["n"]] -= 1
    gone = np.zeros(len(lines), dtype=bool)
    gone[np.flatnonzero(wordy)] = np.cumsum(borders[:-1]) > 0
    return lines, wordy, gone


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, n_runs: lines with a word, those that are later copies, and the runs they form.

    docs: doc_id, text and any other columns, in a stored table. Null and blank texts have no lines. Rows with the same doc_id are ordered by
    their place in the table, so a repeated row is a later copy. Lines are compared as they are; an empty table gives no rows.
    """
    store = Store(docs.sparkSession, "linededup")
    marked = _marked(with_row(docs.select("doc_id", "text")), store, min_words)

    @F.pandas_udf("n_lines long, n_deleted long, n_runs long")
    def count(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            _, wordy, gone = split_lines(text, own)
            gone = gone[wordy]
            out.append((len(gone), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())))
        return pd.DataFrame(out, columns=["n_lines", "n_deleted", "n_runs"])

    return marked.select("doc_id", count("text", "spans").alias("c")).select("doc_id", "c.*")


def delete_repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with later copies of line runs taken out of ``text``; all columns stay, and so do blank lines.

    A document that loses lines and has no word left goes, as all it held is kept elsewhere. If docs has n_chars, it follows
    the new text.
    """
    store = Store(docs.sparkSession, "linededup")
    # the other columns travel in one, so their names meet none of ours
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("others")
    marked = _marked(with_row(docs.select("doc_id", "text", others)), store, min_words)

    @F.pandas_udf("string")
    def kept(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans):
            lines, wordy, gone = split_lines(text, own)
            out.append("\n".join(line for line, g in zip(lines, gone) if not g) if (wordy & ~gone).any() else None)
        return pd.Series(out, dtype="object")

    touched = F.col("spans").isNotNull()
    marked = marked.withColumn("left", F.when(touched, kept("text", "spans"))).where(~touched | F.col("left").isNotNull())
    text = F.when(touched, F.col("left")).otherwise(F.col("text"))
    columns = {c: text if c == "text" else F.col(f"others.`{c}`") for c in docs.columns}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(touched, F.length("left")).otherwise(columns["n_chars"]).cast(kind)
    return marked.select(*(value.alias(c) for c, value in columns.items()))


#: DuckDB statement for the query (with MIN_WORDS 5): every run of 1 to 5 lines is spelled out.
LINE_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos
  FROM split WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
runs AS (
  SELECT l.doc_id, l.pos AS start, k.n,
         string_agg(m.line, chr(10) ORDER BY m.pos) AS name, sum(m.words) AS words,
         any_value(l.words) AS first_words, max(m.words) FILTER (m.pos = l.pos + k.n - 1) AS last_words
  FROM lines l CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS n) k
  JOIN lines m ON m.doc_id = l.doc_id AND m.pos BETWEEN l.pos AND l.pos + k.n - 1
  GROUP BY l.doc_id, l.pos, k.n HAVING count(*) = k.n AND sum(m.words) >= 5),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY n, name ORDER BY doc_id, start) AS nth FROM runs),
gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM copies c JOIN lines l ON l.doc_id = c.doc_id AND l.pos BETWEEN c.start AND c.start + c.n - 1
  WHERE c.nth > 1),
numbered AS (
  SELECT doc_id, count(*) AS n_deleted, count(*) FILTER (before IS NULL OR before < pos - 1) AS n_runs
  FROM (SELECT *, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n_lines, 0)::BIGINT AS n_lines, coalesce(n.n_deleted, 0)::BIGINT AS n_deleted,
       coalesce(n.n_runs, 0)::BIGINT AS n_runs
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN numbered n USING (doc_id)
"""
