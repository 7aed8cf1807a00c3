"""Numbers 1, 2, 3, ... over a table in a given order, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basalt.plans.durable import written

LOW = (1 << 33) - 1


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place in ``order``; ties may come in any order, each place is given once.

    Rows are sorted by ranges and written, each with its range and its place there; the
    sizes of the ranges, one number each, are then summed up. Ties are cut among
    ranges too: a share of all rows that ties doesn't go to one task.
    """
    split = rows.withColumn("_salt", F.rand(11))
    placed = split.repartitionByRange(*order, "_salt").sortWithinPartitions(*order, "_salt").drop("_salt")
    done = written(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # range << 33 | place there
    sizes = done.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_base"))  # one row a range
    out = done.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(bases), "_range")
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(LOW) + 1).drop("_range", "_at", "_base")
