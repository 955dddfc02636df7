"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logforge.functions.lineage import materialise
from logforge.functions.skew import hot_keys, spread_join


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v), of which there are about `total`, with m: the least v of the same u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return spread_join(edges, least.drop("n"), ["u"], hot_keys(least, ["u"], total), ["v"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges has two long columns a and b; nulls and loops are ignored, repeated edges and both directions are fine.
    Alternates the large-star and small-star steps (Kiveris et al. 2014), which needs a number of rounds that is
    logarithmic in the number of nodes, whatever the diameter. Each step takes the minimum of a node's neighbours
    by a pre-aggregated groupBy and joins it back; in that join a hub's neighbours are dealt over many tasks.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    pairs = pairs.where(F.col("a") != F.col("b"))
    # u is the larger end
    pairs = materialise(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        total = 2 * pairs.count()
        large = _with_least(both, total).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small = _with_least(large, total).select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        pairs = materialise(small.where(F.col("u") != F.col("v")).distinct())
        # done when the edges form stars: no parent is a child and no child has two parents
        parents = pairs.select(F.col("v").alias("u")).distinct().withColumn("parent", F.lit(1))
        kinds = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).join(parents.hint("merge"), "u", "left")
        if not kinds.where((F.col("n") > 1) | F.col("parent").isNotNull()).limit(1).count():
            break
    else:
        raise RuntimeError("connected components did not settle")
    children = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
