"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.stage import stage


def _hooks(edges: DataFrame, step: int) -> DataFrame:
    """For each node, the first one among itself and its neighbours.

    Nodes are ordered by number and, every other step, by a hash: the first collapses
    stars around their smallest node at once, the second halves chains of any order.
    """

    def rank(node: Column) -> Column:
        return F.xxhash64(node, F.lit(step)) if step % 2 else node

    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.groupBy("a").agg(F.min(rank(F.col("b"))).alias("r"), F.min_by("b", rank(F.col("b"))).alias("b"))
    hook = F.when(rank(F.col("a")) <= F.col("r"), F.col("a")).otherwise(F.col("b"))
    return best.select(F.col("a").alias("node"), hook.alias("to"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component is the smallest node.

    Each step replaces every node by a neighbour and drops loops, until no edge is left;
    the steps' maps are then followed one after the other.  Only whether edges are left
    comes to the driver.  An empty edge table gives an empty result.
    """
    current = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not current.isEmpty():
        hooks = stage(_hooks(current, len(maps)), "hooks")
        maps.append(hooks)
        a = hooks.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = hooks.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        moved = current.join(a, "a").join(b, "b").filter("to_a <> to_b")
        current = stage(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = maps[0]
    for hooks in maps[1:]:
        following = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        label = label.join(following, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
    label = stage(label, "labels")
    smallest = label.groupBy("to").agg(F.min("node").alias("component"))
    return label.join(smallest, "to").select("node", "component")
