"""Token counts of documents in flat, unindexed token files, found by scanning for end-of-document identifiers.

A flat file is one long run of little-endian token identifiers in which one identifier ends each document. Files are read
in blocks that know nothing of documents; a vectorised search finds the separators of each block and a prefix scan over
the blocks' sums stitches the documents that cross block borders.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.store import Store

#: Fixed value: the published pre-tokenization pattern of the byte-level vocabularies.
PIECE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END_OF_DOCUMENT = 50256
BLOCK_TOKENS = 1 << 16
#: Blocks of a file that are summed before the scan over the file.
GROUP_BLOCKS = 1 << 10

_encodings: dict[str, object] = {}


def _encoding(path: str):
    """One encoder per worker process and vocabulary file."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("flat", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def flat_blocks(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data, first, ids: one flat token run per input partition, cut into blocks of ``block_tokens``.

    ``data`` holds little-endian uint16 identifiers; ``first`` and ``ids`` are the writer's own list of the documents that
    end in the block, which the scan never reads. Null texts count as empty.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, file = _encoding(vocabulary), TaskContext.get().partitionId()
        held, held_n, pending = [], 0, []
        block = ended = 0

        def row(data: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"file": [file], "block": [block], "data": [data.astype("<u2").tobytes()], "first": [ended], "ids": [ids]},
                schema=pa.schema([("file", pa.int32()), ("block", pa.int64()), ("data", pa.binary()), ("first", pa.int64()), ("ids", pa.list_(pa.int64()))]),
            )

        def cut(n: int) -> pa.RecordBatch:
            nonlocal held, held_n, pending, block, ended
            data = np.concatenate(held)
            out, rest = data[:n], data[n:]
            k = int(np.count_nonzero(out == end))
            batch = row(out, pending[:k])
            held, held_n, pending = [rest], len(rest), pending[k:]
            block, ended = block + 1, ended + k
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = encoding.encode_ordinary(text.as_py() or "")
                tokens.append(end)
                held.append(np.asarray(tokens, dtype=np.uint16))
                held_n += len(tokens)
                pending.append(doc_id)
                while held_n >= block_tokens:
                    yield cut(block_tokens)
        if held_n:
            yield cut(held_n)

    return docs.select("doc_id", "text").mapInArrow(write, "file int, block long, data binary, first long, ids array<long>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, block, data of raw token files: lengths come from the listing, blocks are read by range in the tasks.

    ``path`` is a file, folder or glob that both Spark and pyarrow's file systems can open. Bytes after the last whole
    identifier make the job fail, as the file is then no token file of this width.
    """
    step = block_tokens * width
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")
    blocks = listed.where("length > 0").select(
        "file", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"), "length"
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, block, length in zip(*(c.to_pylist() for c in batch.columns)):
                if length % width:
                    raise ValueError(f"{file} has {length} bytes, not a multiple of {width}")
                system, inner = fs.FileSystem.from_uri(file)
                with system.open_input_file(inner) as source:
                    data = source.read_at(min(step, length - block * step), block * step)
                yield pa.RecordBatch.from_pydict({"file": [file], "block": [block], "data": [data]})

    return blocks.repartition("file", "block").mapInArrow(read, "file string, block long, data binary")


def scan_blocks(blocks: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2) -> DataFrame:
    """file, block, n, seps, head, tail, inner: what a block tells without its neighbours.

    head and tail are the tokens before the first and behind the last separator; inner the lengths between separators.
    """
    kind = f"<u{width}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n", "seps", "head", "tail", "inner")}
            for data in batch.column(2):
                tokens = np.frombuffer(data.as_buffer() or b"", dtype=kind)
                at = np.flatnonzero(tokens == end)
                rows["n"].append(len(tokens))
                rows["seps"].append(len(at))
                rows["head"].append(int(at[0]) if len(at) else len(tokens))
                rows["tail"].append(len(tokens) - 1 - int(at[-1]) if len(at) else len(tokens))
                rows["inner"].append((np.diff(at) - 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(rows[k], pa.int64()) for k in ("n", "seps", "head", "tail")), pa.array(rows["inner"], pa.list_(pa.int64()))],
                names=["file", "block", "n", "seps", "head", "tail", "inner"],
            )

    file_type = dict(blocks.dtypes)["file"]
    return blocks.select("file", "block", "data").mapInArrow(
        scan, f"file {file_type}, block long, n long, seps long, head long, tail long, inner array<long>"
    )


def stitch_blocks(scanned: DataFrame) -> DataFrame:
    """file, ordinal, n_tokens, closed: the documents of each file in order.

    The scan has two levels, so that a long file is no single group: sums of GROUP_BLOCKS blocks first, then the blocks of
    a group behind their group's start. A run without a separator at the end of a file is a document that is not closed.
    """
    rows = scanned.withColumn("chunk", F.expr(f"block div {GROUP_BLOCKS}"))
    inside = W.partitionBy("file", "chunk").orderBy("block")
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    # positions count from the start of the group; last is the position behind the last separator so far
    rows = (
        rows.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .withColumn("docs", F.coalesce(F.sum("seps").over(before), F.lit(0)))
        .withColumn("behind", F.when(F.col("seps") > 0, F.col("start") + F.col("n") - F.col("tail")))
        .withColumn("last", F.max("behind").over(before))
    )
    chunks = rows.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max("behind").alias("behind"))
    over = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("chunk_start", F.coalesce(F.sum("n").over(over), F.lit(0))).withColumn(
        "chunk_docs", F.coalesce(F.sum("seps").over(over), F.lit(0))
    )
    chunks = chunks.withColumn("chunk_last", F.coalesce(F.max(F.col("chunk_start") + F.col("behind")).over(over), F.lit(0)))
    final = F.max("chunk").over(W.partitionBy("file"))
    chunks = chunks.withColumn("final", F.col("chunk") == final).select("file", "chunk", "chunk_start", "chunk_docs", "chunk_last", "final")
    rows = rows.join(chunks, ["file", "chunk"])
    carried = F.col("chunk_start") + F.col("start") - F.coalesce(F.col("chunk_start") + F.col("last"), F.col("chunk_last"))
    lengths = F.when(F.col("seps") > 0, F.concat(F.array(carried + F.col("head")), F.col("inner"))).otherwise(F.array().cast("array<long>"))
    first = F.col("chunk_docs") + F.col("docs")
    done = rows.select("file", first.alias("first"), F.posexplode(lengths).alias("k", "n_tokens")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")
    )
    open_length = F.when(F.col("seps") > 0, F.col("tail")).otherwise(carried + F.col("n"))
    last_block = F.col("final") & (F.col("block") == F.max("block").over(W.partitionBy("file", "chunk")))
    left = rows.withColumn("is_last", last_block).where("is_last").select(
        "file", (first + F.col("seps")).alias("ordinal"), open_length.alias("n_tokens"), F.lit(False).alias("closed")
    )
    return done.unionByName(left.where("n_tokens > 0"))


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens of every document, by way of flat token files.

    The documents are written as flat runs into the shared folder, scanned in blocks, stitched, and matched with the
    writer's order. Null and empty texts have 0 tokens; a text that spells the separator is ordinary text; repeated rows
    are rows of their own; an empty table gives no rows; other columns are not read.
    """
    store = Store(docs.sparkSession, "tokencounts")
    blocks = store.put(flat_blocks(docs, vocabulary, end, block_tokens), "flat")
    scanned = store.put(scan_blocks(blocks, end), "scanned")
    order = blocks.select("file", "first", F.posexplode("ids").alias("k", "doc_id")).select(
        "file", (F.col("first") + F.col("k")).alias("ordinal"), "doc_id"
    )
    return stitch_blocks(scanned).join(order, ["file", "ordinal"]).select("doc_id", "n_tokens")
