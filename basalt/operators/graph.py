"""The revision graph. ``edges`` are (child, parent), ``nodes`` (node)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basalt.operators.validate import CatalogError
from basalt.plans.durable import checkpoint


def heads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no supplied node names as parent."""
    return nodes.join(edges.select(F.col("parent").alias("node")).distinct(), "node", "left_anti")


def missing_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents that weren't supplied."""
    return edges.select(F.col("parent").alias("node")).distinct().join(nodes, "node", "left_anti")


def ancestor_closure(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, ancestor) for all ancestors, by doubling path lengths: log2(depth) rounds."""
    paths = checkpoint(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).distinct())
    n = paths.count()
    for _ in range(rounds):
        right = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"))
        longer = paths.join(right, "ancestor").select("node", F.col("far").alias("ancestor"))
        paths = checkpoint(paths.union(longer).distinct())
        n, before = paths.count(), n
        if n == before:
            return paths
    raise CatalogError("input", "ancestry too deep")


def incomplete(closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node): those with an ancestor that wasn't supplied."""
    return closure.join(nodes.select(F.col("node").alias("ancestor")), "ancestor", "left_anti").select("node").distinct()


def incomparable(pairs: DataFrame, closure: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) of which neither is the other's ancestor, both ancestries complete."""
    gaps = incomplete(closure, nodes)
    for side in ("a", "b"):
        pairs = pairs.join(gaps.withColumnRenamed("node", side), side, "left_anti")
    pairs = pairs.join(closure.select(F.col("node").alias("a"), F.col("ancestor").alias("b")), ["a", "b"], "left_anti")
    return pairs.join(closure.select(F.col("node").alias("b"), F.col("ancestor").alias("a")), ["a", "b"], "left_anti").where("a <> b")


def _peel(edges: DataFrame, side: str, other: str) -> DataFrame:
    """Edges left when ends that nothing leads to on ``other``'s side are taken off again and again."""
    n = edges.count()
    while n:
        live = edges.select(F.col(side).alias(other)).distinct()
        edges = checkpoint(edges.join(live, other, "left_semi"))
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or between two cycles: what peeling from both sides leaves. Empty for a sound graph."""
    left = _peel(_peel(checkpoint(edges.distinct()), "child", "parent"), "parent", "child")
    return left.select(F.col("child").alias("node")).union(left.select("parent")).distinct()


def tombstone_live_conflicts(live: DataFrame, dead: DataFrame, closure: DataFrame, nodes: DataFrame, bodies: bool = False) -> DataFrame:
    """(identity, n_claims), with ``bodies`` also claims in order, alive at one head and dead at another, neither being the other's ancestor.

    live, dead: (head, identity, body). What one head holds both of is dead there. Heads
    with missing ancestors decide nothing.
    """
    alive = live.join(dead.select("head", "identity").distinct(), ["head", "identity"], "left_anti")
    pairs = alive.select(F.col("head").alias("a"), "identity").distinct().join(dead.select(F.col("head").alias("b"), "identity").distinct(), "identity")
    found = incomparable(pairs, closure, nodes).select("identity").distinct()
    claims = alive.select("identity", "body").union(dead.select("identity", "body")).distinct()
    listed = [F.array_sort(F.collect_list("body")).alias("claims")] if bodies else []
    return claims.join(found, "identity").groupBy("identity").agg(F.count("*").alias("n_claims"), *listed)


def maximal_generations(snapshots: DataFrame, closure: DataFrame, record: str, generation: str, where: Column | None = None) -> DataFrame:
    """Of each record the generations that no other of its generations comes after: one, or several that are concurrent.

    ``closure`` is (node, ancestor) over generations. ``where`` are exact filters of the
    result, which reach the scan of what is returned; what makes a generation obsolete
    is any generation of its record, whether it passes the filters or not.
    """
    own = snapshots.select(F.col(record).alias("_record"), F.col(generation).alias("node"))
    after = closure.join(own, "node").select("_record", F.col("ancestor").alias("_old")).distinct()
    kept = snapshots if where is None else snapshots.where(where)
    return kept.join(after, (kept[record] == after["_record"]) & (kept[generation] == after["_old"]), "left_anti")
