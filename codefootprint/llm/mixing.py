"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame operations only."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codefootprint.llm.store import Store, numbered, unused_name, with_row
from codefootprint.llm.words import WORD_PATTERN

#: Documents of a source are dealt to 16**BUCKET_DIGITS buckets by their seeded digest; only one of them is ever ordered.
BUCKET_DIGITS = 3


def _source_key(source: Column) -> Column:
    """One non-null key per source; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sized_documents(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, its key, size in words and the seeded digest. Null texts have size 0."""
    return docs.select(
        "doc_id",
        "source",
        _source_key(F.col("source")).alias("source_key"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"mix-{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("digest"),
    )


def cyclic_weights(store: Store, sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """source_key and weight: the cycle's weights, repeating, over the sources in code point order, null last."""
    ranked = numbered(store, sources.withColumn("null_last", F.col("source").isNull()), "rank", "null_last", "source")
    return ranked.select(
        "source_key", F.element_at(F.array(*map(F.lit, cycle)), (F.col("rank") % len(cycle) + 1).cast("int")).cast("long").alias("weight")
    )


def source_targets(sources: DataFrame, total: int, max_epochs: int) -> DataFrame:
    """Adds target: weight shares of ``total``, no target above ``max_epochs`` times the size, the excess shared by weight.

    sources: source_key, source_size, weight (whole numbers). Each round clamps the sources above their cap and shares what
    is left among the others; the level only rises, so a clamped source stays clamped and the rounds end. The driver sees
    three sums a round.
    """
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cap = exact("source_size") * F.lit(max_epochs).cast("decimal(9,0)")
    left, shares, clamped = Decimal(total), sources.agg(F.sum("weight")).first()[0] or 0, 0

    def is_clamped() -> Column:
        return cap * F.lit(Decimal(shares)).cast("decimal(18,0)") < exact("weight") * F.lit(left).cast("decimal(19,0)")

    while shares:
        now = is_clamped()
        n, taken, free = sources.agg(
            F.count(F.when(now, 1)), F.sum(F.when(now, cap)), F.sum(F.when(~now, F.col("weight")))
        ).first()
        if n == clamped:
            break
        clamped, left, shares = n, Decimal(total) - Decimal(taken or 0), free or 0
    level = is_clamped() if shares else F.lit(True)
    share = (exact("weight") * F.lit(left).cast("decimal(19,0)")).cast("double") / F.lit(float(shares or 1))
    return sources.withColumn("target", F.when(level, cap.cast("double")).otherwise(share))


def mix_sources(
    docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: int = 42, cycle: tuple[int, ...] = (5, 2, 1)
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, part_words, taken: what a mix takes from each document.

    docs: doc_id, text, source and any other columns. weights: source, weight (positive whole numbers, one row each; null is
    a source); where none are given, ``cycle`` repeats over the sources in code point order. Targets come from
    ``source_targets`` with 100 % of all words. A source's rounded target is reached with whole copies of all its documents,
    and a part: documents in the order of a seeded digest until the rest is filled, the last one only with its first words
    that still fit. So a source meets its target to the word and no document exceeds ``max_epochs`` times its size.

    Null and blank texts have size 0 and are never taken. A null source is a source. Rows with the same doc_id are rows of
    their own. An empty table gives no rows. Reruns agree; documents of equal digest, id and size are interchangeable.
    """
    spark: SparkSession = docs.sparkSession
    store = Store(spark, "mixing")
    sized = store.put(
        sized_documents(docs, seed).withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS)), "sized"
    )
    buckets = store.put(
        sized.groupBy("source_key", "bucket").agg(F.max("source").alias("source"), F.sum("size").alias("bucket_size")), "buckets"
    )
    sources = buckets.groupBy("source_key").agg(F.max("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    if weights is None:
        sources = store.put(sources, "sources")
        weighted = cyclic_weights(store, sources, cycle)
    else:
        weighted = weights.select(_source_key(F.col("source")).alias("source_key"), F.col("weight").cast("long").alias("weight"))
    sources = store.put(
        sources.join(weighted, "source_key", "left").select("source_key", "source_size", F.coalesce("weight", F.lit(0)).alias("weight")),
        "weighted",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal = F.floor(F.col("target") + 0.5).cast("long")
    plan = (
        source_targets(sources, total, max_epochs)
        .withColumn("goal", goal)
        .withColumn("copies", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("part", F.col("goal") - F.col("copies") * F.col("source_size"))
        .select("source_key", "source_size", "target", "copies", "part")
    )
    running = F.sum("bucket_size").over(W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edges = buckets.withColumn("before", running - F.col("bucket_size")).join(plan, "source_key").select(
        "source_key", "bucket", "source_size", "target", "copies", (F.col("part") - F.col("before")).alias("room"), "bucket_size"
    )
    ahead = F.sum("size").over(
        W.partitionBy("source_key", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    ) - F.col("size")
    return (
        sized.join(edges, ["source_key", "bucket"])
        .withColumn("part_words", F.greatest(F.lit(0), F.least("size", F.col("room") - ahead)).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size") + F.col("part_words"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "part_words", "taken")
    )


def mix_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs (a stored table) that a mix takes, all columns, with size, source_size, target, copies, part_words and taken.

    settings as for ``mix_sources``; columns of these names in docs are replaced.
    """
    row = unused_name(docs, "row")
    rows = with_row(docs, row)
    mixed = mix_sources(rows.select(F.col(row).alias("doc_id"), "text", "source"), **settings).where("taken > 0")
    mixed = mixed.drop("source").withColumnRenamed("doc_id", row)
    kept = [c for c in docs.columns if c not in mixed.columns]
    return rows.select(row, *(F.col(f"`{c}`") for c in kept)).join(mixed.hint("merge"), row).drop(row)


#: DuckDB statement for the rows of the query; the closed form of the water level replaces the rounds.
MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-42:' || coalesce(doc_id::VARCHAR, '')) AS digest
  FROM documents),
sources AS (
  SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::HUGEINT AS weight,
         sum(source_size) OVER () AS total
  FROM sources),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS k FROM weighted),
levels AS (
  SELECT *, total - coalesce(3 * sum(source_size) OVER before, 0) AS rest, coalesce(sum(weight) OVER after, 0) AS shares
  FROM ordered
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (
  SELECT rest, shares, k AS first_free FROM levels WHERE 3 * source_size * shares >= weight * rest ORDER BY k LIMIT 1),
plan AS (
  SELECT o.source, o.source_size,
         CASE WHEN o.k < l.first_free THEN (3 * o.source_size)::DOUBLE ELSE (o.weight * l.rest)::DOUBLE / l.shares::DOUBLE END AS target
  FROM ordered o, level l),
goals AS (
  SELECT *, floor(target + 0.5)::HUGEINT AS goal,
         CASE WHEN source_size > 0 THEN floor(target + 0.5)::HUGEINT // source_size ELSE 0 END AS copies FROM plan),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, g.copies, g.goal - g.copies * g.source_size AS part,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (copies * size + greatest(0, least(size, part - ahead)))::BIGINT AS taken
FROM placed
"""
