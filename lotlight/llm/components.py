"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlight.llm.common import counted_join, durable, forget


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """`edges` has long columns a and b. Returns node, root for every node that has a link; root is its component's least node.

    Each round is a few shuffles of the edges and ends in a checkpoint, which
    replaces the one before; only a count and a checksum of them reach the driver.
    A node's least neighbour is found with partial aggregation and meets the
    node's edges by `counted_join`, so that a hub's edges are not gathered in one task.
    """
    spark = edges.sparkSession
    pairs = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = durable(pairs)
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = state(pairs)
    if not before[0]:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for _ in range(max_rounds):
        total = 2 * before[0]
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = durable(counted_join(both, least, "a", total).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = counted_join(large, least, "a", total)
        small = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        new = durable(small)
        forget(spark, pairs, large)
        pairs, now = new, state(new)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
