"""Connected components by alternating large-star and small-star rounds.

Each round is grouped minima and joins; no neighbour list is ever gathered, so a
vertex with any number of links costs its links and no more memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basalt.plans.durable import checkpoint, tidy


def unaligned(df: DataFrame, key: str) -> DataFrame:
    """``df`` with an integer key that Spark doesn't know to be spread by that key.

    A join of grouped rows with the rows they came from then shuffles both sides, and
    adaptive execution can split a hot key of the larger one over several tasks.
    """
    return df.withColumn(key, F.call_function("shiftleft", F.col(key), F.lit(0)))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): for every vertex of ``edges`` (a, b), the smallest vertex it reaches."""
    e = checkpoint(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    for _ in range(rounds):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(unaligned(least, "x"), "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = checkpoint(small.union(own.select("u", F.col("m").alias("v"))).distinct())
        after = state(e)
        del both, least, large, own, small
        tidy(edges.sparkSession)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
