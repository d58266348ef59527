"""Centroid clustering of integer vectors over Hilbert-ordered blocks with zone maps.

Vectors are ordered along a Hilbert curve through all their components and cut into blocks that carry the smallest and
largest value of each component. In a round, a block's box bounds its distance to every centroid from below and above; a
centroid whose lower bound exceeds the least upper bound is nearest to no vector of the block, so only the others are
compared, exactly and vectorised. Blocks are stored once and read in every round; a round sends one row per cluster and
component to the driver. Arithmetic is on whole numbers throughout, so results don't depend on how rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store

#: Bits of the Hilbert curve per component, and vectors in a block.
CURVE_BITS = 2
BLOCK_ROWS = 128
#: Components beyond this are out of reach: squared distances of larger ones don't fit 64 bits.
LARGEST = 1 << 27
#: Up to this, float64 products and sums of 64 components are exact, so the matrix product can be used.
EXACT_IN_FLOAT = 1 << 21


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of cells (vectors x components, values below 2**bits), as bytes that sort like it."""
    x = cells.T.astype(np.int64)
    for b in range(bits - 1, 0, -1):  # undo the excess turns of each level, from the coarsest
        q, low = 1 << b, (1 << b) - 1
        for i in range(len(x)):
            turn = (x[i] & q) != 0
            swap = np.where(turn, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):  # Gray code across the components
        x[i] ^= x[i - 1]
    parity = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        parity ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= parity
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)]).astype(np.uint8)
    return np.packbits(planes.reshape(-1, x.shape[1]).T, axis=1)


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances as int64, vectors x centroids."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_FLOAT and vectors.shape[1] <= 64:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors.astype(np.int64) - c) ** 2).sum(1) for c in centroids], axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector in the box."""
    outside = np.maximum(np.maximum(low - centroids, centroids - high), 0)
    farthest = np.maximum(np.abs(centroids - low), np.abs(centroids - high))
    return np.flatnonzero((outside**2).sum(1) <= (farthest**2).sum(1).min())


def _assigned(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray, np.ndarray]]:
    """For each block: its ids, vectors, nearest centroids and their distances."""
    width = centroids.shape[1]
    for ids, kind, raw, low, high in zip(*(batch.column(c) for c in ("ids", "kind", "vectors", "low", "high"))):
        vectors = np.frombuffer(raw.as_py(), dtype=kind.as_py()).reshape(-1, width).astype(np.int64)
        near = candidates(*(np.frombuffer(x.as_py(), dtype=np.int64) for x in (low, high)), centroids)
        apart = distances(vectors, centroids[near])
        first = apart.argmin(axis=1)  # the first of equals, and near is ascending
        yield ids, vectors, near[first], apart[np.arange(len(vectors)), first]


def to_blocks(vectors: DataFrame, store: Store, components: int) -> DataFrame:
    """Blocks of (id, v) rows in Hilbert order: ids, kind (number type of the bytes), vectors, low, high.

    Equal vectors are dealt over several partitions by id and a seeded number, so copies of one vector fill no task.
    """
    edges = vectors.select(F.posexplode("v").alias("at", "x")).groupBy("at").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    rows = sorted(edges.collect())  # one per component
    low, high = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("a", "b"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.float64)
            cells = ((v - low) / np.maximum(high - low + 1, 1) * (1 << CURVE_BITS)).astype(np.int64)
            found = hilbert_keys(cells, CURVE_BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([k.tobytes() for k in found], pa.binary())], names=["id", "v", "key"]
            )

    kind_of_id = vectors.schema["id"].dataType.simpleString()
    keyed = vectors.select("id", "v").mapInArrow(keys, f"id {kind_of_id}, v array<bigint>, key binary")
    order = ("key", "id", "spread")
    ordered = keyed.withColumn("spread", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                v = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components)
                kind = "<i2" if np.abs(v).max() < 1 << 15 else "<i4"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(part.schema.field(0).type)), pa.array([kind]),
                        *(pa.array([x.tobytes()], pa.binary()) for x in (v.astype(kind), v.min(0), v.max(0))),
                    ],
                    names=["ids", "kind", "vectors", "low", "high"],
                )

    return store.put(
        ordered.mapInArrow(pack, f"ids array<{kind_of_id}>, kind string, vectors binary, low binary, high binary"), "blocks"
    )


def _means(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The next centroids: exact floor of the mean of each one's vectors; one without vectors stays."""
    k, width = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for _, vectors, cluster, _ in _assigned(batch, centroids):
                np.add.at(total, cluster, vectors)
                n += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(used, width)), pa.array(np.tile(np.arange(width), len(used))),
                pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width)),
            ],
            names=["cluster", "at", "total", "n"],
        )

    summed = (
        blocks.mapInArrow(sums, "cluster long, at long, total long, n long").groupBy("cluster", "at")
        .agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("total", "n")))
    )
    out = centroids.copy()
    for r in summed.collect():  # at most centroids x components rows
        out[r.cluster, r["at"]] = int(r.total) // int(r.n)
    return out


def cluster_vectors(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 40, rounds: int = 5,
    components: int = 64, scale: int = 256, seed: int = 2,
) -> DataFrame:
    """Lloyd's rounds on integer vectors, then one assignment: id_col, cluster, distance, centroid, cluster_inertia, inertia.

    Kept are vectors of exactly ``components`` components, none null or not finite, each turned into floor(scale * x).
    Vectors with a component beyond LARGEST are left out too, because their distances don't fit a long. Centroids
    start as the k kept vectors with the smallest sha256 of "seed:id" (null ids last, equal ones by their components),
    fewer if fewer are kept; without any, the result is empty. Ties go to the smaller number. Repeated rows count and
    return as often as they stand there. Other columns are not read.
    """
    spark = rows.sparkSession
    store = Store(spark, "centroids")
    x = F.col(f"`{vector_col}`")
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    usable = (F.size(x) == components) & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) <= LARGEST / scale)
    )
    kept = rows.where(usable).select(F.col(f"`{id_col}`").alias("id"), scaled.alias("v"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in first], dtype=np.int64).reshape(-1, components)
    kind_of_id = kept.schema["id"].dataType.simpleString()
    if not len(centroids):
        assigned = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0)
    else:
        blocks = to_blocks(kept, store, components)
        for _ in range(rounds):
            centroids = _means(blocks, centroids)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, _, cluster, apart in _assigned(batch, centroids):
                    yield pa.RecordBatch.from_arrays(
                        [ids.values, pa.array(cluster.astype(np.int32)), pa.array(apart)], names=["id", "cluster", "distance"]
                    )

        assigned = store.put(blocks.mapInArrow(assign, f"id {kind_of_id}, cluster int, distance long"), "assigned")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # k rows
    whole = sum(int(r.s) for r in sums)
    facts = spark.createDataFrame(
        [(int(r.cluster), centroids[r.cluster].tolist(), int(r.s), whole) for r in sums],
        "cluster int, centroid array<bigint>, cluster_inertia bigint, inertia bigint",
    )
    return assigned.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "centroid", "cluster_inertia", "inertia"
    )


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The same rounds as a chain of DuckDB tables, each vector compared with every centroid."""
    steps = []
    for n in range(rounds + 1):
        steps.append(f"""
  near{n} AS (
    SELECT row, any_value(vec_id) AS vec_id, any_value(a.v) AS v, min(d) AS distance, arg_min(c, d * 1000 + c) AS cluster
    FROM (SELECT kept.row, kept.vec_id, kept.v, c.c,
                 list_sum(list_transform(list_zip(kept.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
          FROM kept CROSS JOIN c{n} c) a GROUP BY row)""")
        if n < rounds:
            steps.append(f"""
  parts{n} AS (
    SELECT cluster, place, sum(v[place])::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM near{n}, range(1, 65) t(place) GROUP BY cluster, place),
  c{n + 1} AS (
    SELECT c.c, coalesce(m.v, c.v) AS v FROM c{n} c LEFT JOIN (
      SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS v FROM parts{n} GROUP BY cluster
    ) m ON m.cluster = c.c)""")
    return f"""
WITH kept AS (
    SELECT row_number() OVER () AS row, vec_id,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
  c0 AS (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v FROM kept
    ORDER BY sha256('2:' || vec_id), v LIMIT {k}),{",".join(steps)}
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN c{rounds} ON c{rounds}.c = cluster"""


CLUSTER_SQL = _cluster_sql()
