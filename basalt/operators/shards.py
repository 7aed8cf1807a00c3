"""Adaptive prefix partitions of routed records, and the manifest that lists them."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions.scalars import hex_successor
from basalt.operators.ordered import Ordered
from basalt.operators.ordered_digest import ordered_digest
from basalt.operators.validate import CatalogError
from basalt.plans.durable import checkpoint
from basalt.plans.limits import EMPTY_SHARD, V2

HEX = "0123456789abcdef"


def adaptive_leaves(records: DataFrame, most: int = V2["records_per_leaf"], target: int = V2["shard_target"], step: int = 3) -> DataFrame:
    """(prefix, n, bytes): the leaves of the 16-ary trie over ``route``, empty siblings too.

    A prefix splits while it has over ``most`` records or its encoding is over ``target``;
    one record always fits. records: route, bytes. One aggregation of the records gives
    the counts ``step`` digits deep and all coarser ones are summed from those; only
    records under prefixes that don't fit there are looked at again, no more digits deeper than
    the largest of them needs if routes are even, so that there are few times as many counts as leaves.
    """
    leaves, inner, depth, largest, more = [], [], 0, None, step
    rows = records.select("route", "bytes")
    top = records.sparkSession.createDataFrame([("",)], "prefix string")  # the root splits or is the one leaf
    while True:
        deep = depth + more
        fine = rows.groupBy(F.substring("route", 1, deep).alias("deep")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
        fine = checkpoint(fine)
        levels = fine.select("deep", "n", "b", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d"))
        sums = levels.groupBy("d", F.expr("left(deep, d)").alias("prefix")).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        size = F.lit(len(EMPTY_SHARD) - 1) + F.col("d") + F.col("b") + F.col("n")
        sums = checkpoint(sums.withColumn("fits", (F.col("n") == 1) | ((F.col("n") <= most) & (size <= target))))
        # a path ends at the first prefix that fits
        path = fine.select("deep", F.explode(F.sequence(F.lit(depth), F.lit(deep))).alias("d")).withColumn("prefix", F.expr("left(deep, d)"))
        path = path.join(sums.select("prefix", "d", "fits"), ["prefix", "d"])
        ends = path.groupBy("deep").agg(F.min(F.when(F.col("fits"), F.col("d"))).alias("end"))
        ends = checkpoint(ends)
        leaf = ends.where("end IS NOT NULL").select(F.expr("left(deep, end)").alias("prefix")).distinct()
        leaves.append(leaf.join(sums, "prefix").select("prefix", "n", F.col("b").cast("bigint").alias("bytes")))
        last = F.coalesce(F.col("end") - 1, F.lit(deep - 1))
        split = ends.where(last >= depth).select("deep", F.explode(F.sequence(F.lit(depth), last)).alias("d"))
        inner.append(split.select(F.expr("left(deep, d)").alias("prefix")).distinct())
        open_ = ends.where("end IS NULL").select("deep")
        over = fine.join(open_, "deep").agg(F.max("n").alias("n"), F.max("b").alias("b")).first()
        if over["n"] is None:
            break
        if deep >= 64:
            raise CatalogError("limit", "records with one route don't fit")
        rows = rows.join(open_, F.substring("route", 1, deep) == F.col("deep"), "left_semi")
        # routes that the last digits didn't part may be equal further on
        parted = largest is None or over["n"] < largest
        more = min(step, max(1, ceil(log(max(over["n"] / most, over["b"] / target), 16)))) if parted else step
        depth, largest = deep, over["n"]
    found, inside = leaves[0], inner[0]
    for a, b in zip(leaves[1:], inner[1:]):
        found, inside = found.union(a), inside.union(b)
    digits = F.explode(F.split(F.lit(HEX), ""))
    below = inside.select("prefix", digits.alias("digit")).select(F.concat("prefix", "digit").alias("prefix")).union(top)
    empty = below.join(inside, "prefix", "left_anti").join(found.select("prefix"), "prefix", "left_anti")
    return found.union(empty.select("prefix", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("bytes")))


def assign_leaves(records: DataFrame, leaves: DataFrame) -> DataFrame:
    """records with their leaf's ``prefix``; leaves are one per route, so depths are tried together."""
    depths = [r["d"] for r in leaves.select(F.length("prefix").alias("d")).distinct().collect()]  # at most 65 numbers
    tries = records.withColumn("prefix", F.explode(F.array(*(F.substring("route", 1, d) for d in depths)))) if depths else records.withColumn("prefix", F.lit(""))
    return tries.join(leaves.select("prefix"), "prefix")


def cover_violations(leaves: DataFrame, width: int = 64, group: list[str] | None = None) -> DataFrame:
    """(group, prefix, rule): gaps, overlaps and missing ends of the range that the prefixes of each group cover.

    Prefixes are held against their neighbours in one order over all groups, so many
    manifests go in one pass, and a manifest of any size isn't gathered.
    """
    group = group or []
    p = leaves.select(*group, "prefix", F.rpad("prefix", width, "0").alias("start"), F.rpad("prefix", width, "f").alias("end"))
    p = Ordered(p, group, [F.col("start"), F.col("prefix")]).neighbours({"before": "end"})
    rule = (
        F.when(F.col("_first") & (F.col("start") != "0" * width), "first")
        .when(~F.col("_first") & (F.col("start") <= F.col("before")), "overlap")
        .when(~F.col("_first") & (F.coalesce(hex_successor(F.col("before")), F.lit("")) != F.col("start")), "gap")
        .when(F.col("_last") & (F.col("end") != "f" * width), "last")
    )
    return p.select(*group, "prefix", rule.alias("rule")).where("rule IS NOT NULL")


def over_budget(shards: DataFrame, group: str, position: str, length: str, budget: Column | int) -> DataFrame:
    """(group, position, length, used): of each group the first shard, by position, with which the bytes go over the budget.

    ``budget`` is a number or a column of ``shards``, equal in a group. Sums of partitions
    are carried on, so a group isn't gathered. Groups within their budget have no row.
    """
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    rows = shards.select(group, position, F.col(length).cast("bigint").alias("length"), limit.cast("bigint").alias("budget"))
    over = Ordered(rows, [group], [F.col(position)]).running_sum("length", "used").where("used > budget")
    first = over.groupBy(group).agg(F.min_by(F.struct(position, "length", "used"), position).alias("x"))
    return first.select(group, "x.*")


def misplaced(records: DataFrame) -> DataFrame:
    """Records whose ``route`` doesn't start with their ``prefix``."""
    return records.where(~F.startswith("route", F.col("prefix")))


def shard_summary(records: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(prefix, entries, observations, bytes, fingerprint) of each shard, of any size: a worker digests its records as they come in order."""
    entry = (F.col("kind") != "observation").cast("int")
    sums = {"entries": entry, "observations": 1 - entry, "bytes": F.octet_length("body")}
    return ordered_digest(records, [prefix], [F.col("route"), F.col("kind"), F.col("identity")], F.col("body"), sums).drop("records")


def reconcile(references: DataFrame, shards: DataFrame) -> DataFrame:
    """(prefix, rule) where manifest and shards disagree. Both: prefix, entries, observations, bytes, fingerprint."""
    cols = ["entries", "observations", "bytes", "fingerprint"]
    r = references.select("prefix", *(F.col(c).alias(f"r_{c}") for c in cols), F.lit(True).alias("in_r"))
    s = shards.select("prefix", *(F.col(c).alias(f"s_{c}") for c in cols), F.lit(True).alias("in_s"))
    rule = F.when(F.col("in_s").isNull(), "missing").when(F.col("in_r").isNull(), "extra")
    for c in cols:
        rule = rule.when(~F.col(f"r_{c}").eqNullSafe(F.col(f"s_{c}")), c)
    return r.join(s, "prefix", "full_outer").select("prefix", rule.alias("rule")).where("rule IS NOT NULL")


def preflight(references: DataFrame, entries: int, observations: int, most_bytes: int = V2["total_shard_bytes"]) -> DataFrame:
    """One row: whether the sums of the references are those that the root declares and within bounds."""
    total = references.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("entries", "observations", "bytes")))
    return total.withColumns(
        {"entries_ok": F.col("entries") == entries, "observations_ok": F.col("observations") == observations, "bytes_ok": F.col("bytes") <= most_bytes}
    )


def revision_stats(records: DataFrame, live: DataFrame) -> DataFrame:
    """One row about a whole revision. records: kind, identity, epoch; live: bytes."""
    entry = F.col("kind") != "observation"
    r = records.agg(F.count_if(entry).alias("entries"), F.count_if(~entry).alias("observations"), F.countDistinct("epoch").alias("epochs"))
    l = live.agg(F.count("*").alias("live"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("live_bytes"))  # noqa: E741
    return r.join(l, F.lit(True))  # one row each


def order_violations(rows: DataFrame, group: str, position: str, key: str) -> DataFrame:
    """Rows whose key isn't above the one before it in their group, whatever the group's size."""
    return Ordered(rows, [group], [F.col(position)]).neighbours({"before": key}).where(F.col("before") >= F.col(key)).drop("_first", "_last")


def live_set(snapshots: DataFrame, tombstones: DataFrame, key: str, target: str) -> DataFrame:
    return snapshots.join(tombstones.select(F.col(target).alias(key)).distinct(), key, "left_anti")
