"""Neighbours and running sums over an order that all rows share, without a window over all of them.

Rows are sorted by ranges and written, each with its range and its place there. Windows then
stay inside a range. What crosses the edge of a range is a row and a sum for each, which the
driver folds: as many as there are partitions, however many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basalt.plans.durable import written


class Ordered:
    """``rows`` by ``group``, then by ``order``; columns of rows must not begin with ``_``."""

    def __init__(self, rows: DataFrame, group: list[str], order: list[Column]):
        keys = [*(F.col(g) for g in group), *order]
        placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        done = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered")  # range << 33 | place there
        self.rows = done.withColumn("_range", F.shiftright("_at", 33))
        self.group = group
        self.columns = rows.columns

    def _same(self, a: str, b: str) -> Column:
        return F.col(a).eqNullSafe(F.col(b))

    def _edges(self, values: list[str]) -> list:
        """(range, first row, last row) of ranges that hold rows, in order."""
        own = F.struct(F.struct(*self.group).alias("g") if self.group else F.lit(0).alias("g"), F.struct(*values).alias("v") if values else F.lit(0).alias("v"))
        ends = self.rows.groupBy("_range").agg(F.min_by(own, "_at").alias("first"), F.max_by(own, "_at").alias("last"))
        return sorted(ends.collect(), key=lambda r: r["_range"])

    def neighbours(self, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> DataFrame:
        """rows with values of the row before or after: new name -> column. Null where a group begins or ends; ``_first`` and ``_last`` tell where.

        A null among the values is kept apart from having no neighbour.
        """
        before, after = before or {}, after or {}
        names = sorted({*before.values(), *after.values()})
        g = (F.struct(*self.group) if self.group else F.lit(0)).alias("g")
        v = (F.struct(*names) if names else F.lit(0)).alias("v")
        spark, kept = self.rows.sparkSession, self._edges(names)
        w = Window.partitionBy("_range").orderBy("_at")
        own = self.rows.withColumn("_row", F.struct(g, v))
        own = own.withColumns({"_before": F.lag("_row").over(w), "_after": F.lead("_row").over(w)})
        # the last row of the range before and the first of the one after, where ranges meet
        kind = own.schema["_row"].dataType.simpleString()
        edges = [(r["_range"], kept[i - 1]["last"] if i else None, kept[i + 1]["first"] if i + 1 < len(kept) else None) for i, r in enumerate(kept)]
        over = spark.createDataFrame(edges, f"_range bigint, _left {kind}, _right {kind}")
        own = own.join(F.broadcast(over), "_range", "left")
        own = own.withColumns({"_before": F.coalesce("_before", "_left"), "_after": F.coalesce("_after", "_right")})
        near = lambda side: F.col(side).isNotNull() & F.col(f"{side}.g").eqNullSafe(F.col("_row.g"))
        added = {"_first": ~near("_before"), "_last": ~near("_after")}
        added |= {name: F.when(near("_before"), F.col(f"_before.v.{c}")) for name, c in before.items()}
        added |= {name: F.when(near("_after"), F.col(f"_after.v.{c}")) for name, c in after.items()}
        return own.withColumns(added).select(*self.columns, *added)

    def running_sum(self, value: str, name: str) -> DataFrame:
        """rows with ``name``: the sum of the bigints ``value`` in their group up to and with this row; null counts as 0."""
        spark = self.rows.sparkSession
        w = Window.partitionBy("_range", *self.group).orderBy("_at")
        g = (F.struct(*self.group) if self.group else F.lit(0)).alias("g")
        own = self.rows.withColumns({"_g": g, "_sum": F.sum(F.coalesce(F.col(value), F.lit(0)).cast("bigint")).over(w)})
        ends = own.groupBy("_range").agg(F.min_by("_g", "_at").alias("first"), F.max_by(F.struct("_g", "_sum"), "_at").alias("last"))
        carried, edges = (False, None, 0), []
        for r in sorted(ends.collect(), key=lambda r: r["_range"]):  # one row a range
            some, last, total = carried
            before = total if some and last == r["first"] else 0
            edges.append((r["_range"], r["first"], before))
            carried = (True, r["last"]["_g"], r["last"]["_sum"] + (before if r["last"]["_g"] == r["first"] else 0))
        kind = own.schema["_g"].dataType.simpleString()
        own = own.join(F.broadcast(spark.createDataFrame(edges, f"_range bigint, _first {kind}, _carried bigint")), "_range", "left")
        total = F.col("_sum") + F.when(F.col("_g").eqNullSafe(F.col("_first")), F.col("_carried")).otherwise(0)
        return own.select(*self.columns, total.alias(name))
