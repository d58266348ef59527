"""SimHash near-duplicates through tables of Hamming distances to reference fingerprints (pivots).

The references are the 65 staircase fingerprints, reference j having its lowest j bits set, so a fingerprint's table
D[0..64] of distances to them has two uses. Its successive steps D[j+1] - D[j] are +1 or -1; cut into SEGMENTS runs, any
two fingerprints that differ in at most REACH bits have the same steps on at least SEGMENTS - REACH runs, so joining on
every choice of that many runs finds all pairs. And, as each distance changes by at most the distance of the two, a pair
whose tables differ by more than REACH at any reference is discarded before it is verified. (Distances to random
references alone can't be joined on: they all lie within a few units of 32, so nearly all pairs would share a cell.)

Dense groups are linked through neighbours in sorted order first; then only pairs whose groups still differ are compared,
so a large group of near copies never meets as all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.components import connected_components
from codefootprint.llm.store import Store, unused_name, with_row

BITS = 64
SHINGLE = 4
REACH = 4
#: Runs of the table's steps. More runs make longer keys: with 7, 35 keys of 27 bits (enough for some 10**8 different
#: fingerprints), with 9, 126 keys of 35 bits (10**10).
SEGMENTS = 7
#: References at which candidate pairs' distances are compared.
CHECKED = (0, 8, 16, 24, 32, 40, 48, 56)
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the whole text; 0 for null and for texts without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(first[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())], dtype="<u8"
    )
    ones = np.zeros(BITS, dtype=np.int64)
    for part in np.array_split(hashes, max(1, n // 65536)):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Adds fp, the fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn("fp", simhash("text"))


def segments(n: int) -> list[tuple[int, int]]:
    """First bit and width of each run of steps."""
    borders = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(borders, borders[1:])]


def segment_keys(fp: Column, reach: int, n: int) -> list[Column]:
    """One key for every choice of n - reach runs: the steps there (bits of the fingerprint) and the choice's number."""
    runs = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in segments(n)]
    return [F.xxhash64(F.lit(i), *(runs[k] for k in chosen)) for i, chosen in enumerate(combinations(range(n), n - reach))]


def distances(fp: Column) -> list[Column]:
    """The table's entries at the checked references."""
    return [F.bit_count(fp.bitwiseXOR(F.lit((1 << j) - 1))).cast("byte") for j in CHECKED]


def link_fingerprints(store: Store, unique: DataFrame, reach: int = REACH, n_segments: int = SEGMENTS) -> DataFrame:
    """a, b: links between different fingerprints that connect exactly those within ``reach`` of each other, transitively.

    unique: fp, one row each. Links are true pairs; within a group that is connected already, further pairs are left out.
    """
    keyed = store.put(unique.select("fp", F.explode(F.array(*segment_keys(F.col("fp"), reach, n_segments))).alias("key")), "keys")

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if last is not None:
                keys, fps = np.append(last[0], keys), np.append(last[1], fps)
            if len(keys):
                last = keys[-1:], fps[-1:]
                near = (keys[1:] == keys[:-1]) & (np.bitwise_count(fps[1:] ^ fps[:-1]) <= reach)
                yield pa.RecordBatch.from_arrays([pa.array(fps[:-1][near]), pa.array(fps[1:][near])], names=["a", "b"])

    ordered = keyed.select("key", "fp").repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    near = store.put(ordered.mapInArrow(neighbours, "a long, b long").distinct(), "near")
    groups = connected_components(store, near, "groups")

    labelled = store.put(unique.join(groups.withColumnRenamed("v", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "labelled")
    # only keys under which two groups meet still need a look
    keyed = labelled.select("fp", "root", F.explode(F.array(*segment_keys(F.col("fp"), reach, n_segments))).alias("key"))
    open_keys = keyed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_keys = store.put(open_keys, "open")
    table = [d.alias(f"d{j}") for j, d in zip(CHECKED, distances(F.col("fp")))]
    met = store.put(keyed.join(open_keys, "key").select("key", "fp", "root", *table), "met")
    x, y = met.alias("x"), met.alias("y")
    apart = F.greatest(*(F.abs(F.col(f"x.d{j}") - F.col(f"y.d{j}")) for j in CHECKED))
    pairs = x.join(
        y,
        (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & (apart <= reach)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= reach),
    ).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    return near.union(store.put(pairs.distinct(), "far"))


def near_duplicates(docs: DataFrame, reach: int = REACH, n_segments: int = SEGMENTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links, itself included.

    docs: doc_id, text and any other columns. Texts with the same fingerprint are one vertex, so copies are never paired.
    Null texts and texts without words have fingerprint zero, which links like any other. Repeated rows stay rows; a null
    doc_id is only the smallest where no other id is reached. An empty table gives no rows.
    """
    store = Store(docs.sparkSession, "simhash")
    found = store.put(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    unique = store.put(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    links = link_fingerprints(store, unique.select("fp"), reach, n_segments)
    roots = connected_components(store, links, "components").withColumnRenamed("v", "fp")
    joined = store.put(unique.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = store.put(joined.join(least, "root").select("fp", "component_id"), "classes")
    return found.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, reach: int = REACH, n_segments: int = SEGMENTS) -> DataFrame:
    """docs (a stored table) with only the first document (smallest doc_id) of each component of :func:`near_duplicates`; all
    columns stay.

    Texts without words have fingerprint zero, which links like any other, so one of them stays. Of rows with the same
    doc_id, null ids last, one that is its component's first stays.
    """
    store = Store(docs.sparkSession, "keepone")
    row = unused_name(docs, "row")
    rows = with_row(docs, row)
    ids = rows.select(F.col(row).alias("r"), F.col("doc_id").alias("id"))
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), reach, n_segments)
    first = F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("first")
    stay = found.select(F.col("doc_id").alias("r"), "component_id").join(ids, "r").groupBy("component_id").agg(first)
    stay = store.put(stay.select(F.col("first.r").alias(row)), "stay")
    # a merge join at every size: the plan, and what it moves, follows the input evenly
    kept = rows.join(stay.hint("merge"), row, "left_semi")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
