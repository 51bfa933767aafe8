"""Connected components of an undirected graph that is given as edges, without moving edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of longs to (v, comp) for every vertex on an edge to another one; comp is one vertex of the component.

    Each round hooks every vertex to its least neighbour, follows the hooks twice, and contracts; edges inside a
    contracted vertex vanish. Rounds end when no edge is left; their number grows with the logarithm of the longest
    chain. A hub is one row in each aggregate, for the least neighbour is combined before the shuffle.
    """
    left = common.materialise(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = common.materialise(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("p")).select(F.col("a").alias("v"), "p"), "hooks")
        hook = first
        up = first.select(F.col("v").alias("_v"), F.col("p").alias("_p"))
        for _ in range(2):  # a vertex that is its own hook stays
            hook = hook.join(up, F.col("p") == F.col("_v")).select("v", F.col("_p").alias("p"))
        hook = common.materialise(hook, "parents")
        common.discard(first)
        if labels is None:
            moved = hook.select("v", F.col("p").alias("comp"))
        else:
            moved = labels.join(hook.select(F.col("v").alias("comp"), "p"), "comp", "left").select("v", F.coalesce("p", "comp").alias("comp"))
        old, labels = labels, common.materialise(moved, "labels")
        pa = hook.select(F.col("v").alias("a"), F.col("p").alias("pa"))
        pb = hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        met = left.join(pa, "a").join(pb, "b").where(F.col("pa") != F.col("pb"))
        before, left = left, common.materialise(met.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        common.discard(hook, before, *([old] if old is not None else []))
    if labels is None:
        return left.select(F.col("a").alias("v"), F.col("b").alias("comp"))
    common.discard(left)
    return labels
