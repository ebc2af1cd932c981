"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a grouped minimum (partially aggregated before the shuffle) joined back to the edges. Nodes
with very many edges are few, so their minima are broadcast and their edges are never shuffled by the
hub; all others meet theirs in an equi join.

Cases: loops are left out; repeated and reversed edges count once; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscope.llm.common import join_by_count, removed, saved, scratch


def with_least(edges: DataFrame, n_edges: int) -> DataFrame:
    """(a, b) to (a, b, m): m is the least of a and of all b of that a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return join_by_count(edges, least, "a", "n", n_edges)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root) for every node with an edge to another; root is the least node of its component."""
    spark = edges.sparkSession
    path = scratch(spark, "edges")
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", path)
    before, seen = None, digest(now)
    while before != seen and seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large_path, next_path = scratch(spark, "large"), scratch(spark, "edges")
        large = saved(with_least(both, 2 * seen[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", large_path)
        small = with_least(large, 2 * seen[0])
        ends = small.select(F.inline(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))))
        now = saved(ends.where("a <> b").distinct(), "edges", next_path)
        removed(spark, path)
        removed(spark, large_path)
        path = next_path
        before, seen = seen, digest(now)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def digest(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, and hardly ever else."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40)), F.sum(F.xxhash64("b", "a") % (1 << 40))).first())
