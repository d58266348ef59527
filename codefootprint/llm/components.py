"""Connected components of a large graph by repeated contraction to smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefootprint.llm.store import Store


def connected_components(store: Store, edges: DataFrame, label: str = "components") -> DataFrame:
    """v, root: for each vertex with an edge the smallest vertex that it reaches. edges: a, b (comparable, not null).

    Each round points every vertex at its smallest neighbour (a minimum, summed up in the tasks, so a hub is no hot key),
    follows the pointers twice, and goes on with the edges between the groups so made; at least half of the vertices go
    every round, so the rounds are logarithmic. Every round's tables are stored; the driver sees one count.
    """
    pairs = edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = store.put(pairs, f"{label}-edges")
    steps = []
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("n")).select(F.col("a").alias("v"), F.least("a", "n").alias("p"))
        parent = store.put(parent, f"{label}-parents")
        for _ in range(2):
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("v", F.col("q").alias("p"))
        parent = store.put(parent, f"{label}-groups")
        steps.append(parent)
        left = parent.select(F.col("v").alias("a"), F.col("p").alias("x"))
        right = parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        pairs = (
            pairs.join(left, "a").join(right, "b").where("x != y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        pairs = store.put(pairs, f"{label}-edges")
    if not steps:
        return pairs.select(F.col("a").alias("v"), F.col("b").alias("root"))
    # groups of a round are vertices of the next: follow them from the last round back
    found = steps[-1].select("v", F.col("p").alias("root"))
    for step in reversed(steps[:-1]):
        found = store.put(
            step.join(found.select(F.col("v").alias("p"), "root"), "p", "left").select("v", F.coalesce("root", "p").alias("root")),
            f"{label}-roots",
        )
    return found
