"""Packing shards into larger objects with verifiable extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from basalt.operators.validate import CatalogError, violations
from basalt.plans.limits import PACK_TARGET
from basalt.plans.schemas import DIGEST

#: Shards that a task packs, and then orders by their offsets: so few that it needs little memory.
TASK = 250_000


def greedy_pack(shards: DataFrame, group: str, order: str, length: str, target: int = PACK_TARGET) -> DataFrame:
    """(group, shard, length, pack, offset): shards in order, a new pack when one would overflow.

    Sequential inside a group (a revision, of at most 1024 shards); groups run side by side, in as many
    tasks as there are ``TASK`` shards, so that memory of one doesn't grow with the input.
    """
    tasks = max(shards.sparkSession.sparkContext.defaultParallelism, -(-shards.count() // TASK))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("shard"), F.col(length).cast("bigint").alias("length"))))
    out = "array<struct<shard:{0},length:bigint,pack:int,offset:bigint>>".format(shards.schema[order].dataType.simpleString())
    begin = F.struct(F.lit(0).alias("pack"), F.lit(0).cast("bigint").alias("used"), F.array().cast(out).alias("out"))

    def step(acc, x):
        full = (acc["used"] > 0) & (acc["used"] + x["length"] > target)
        pack, at = F.when(full, acc["pack"] + 1).otherwise(acc["pack"]), F.when(full, 0).otherwise(acc["used"])
        one = F.struct(x["shard"].alias("shard"), x["length"].alias("length"), pack.alias("pack"), at.cast("bigint").alias("offset"))
        return F.struct(pack.alias("pack"), (at + x["length"]).cast("bigint").alias("used"), F.concat(acc["out"], F.array(one)).alias("out"))

    packed = shards.select(group, order, length).repartition(tasks, group).groupBy(group).agg(F.aggregate(rows, begin, step, lambda a: a["out"]).alias("x"))
    return packed.select(group, F.explode("x").alias("x")).select(group, "x.*")


def too_large(shards: DataFrame, length: str, target: int = PACK_TARGET) -> DataFrame:
    """Shards that fit into no pack."""
    return shards.where(F.col(length) > target)


def build_packs(pieces: DataFrame) -> DataFrame:
    """(group, pack, data, hash) from pieces (group, pack, offset, data binary)."""
    rows = F.array_sort(F.collect_list(F.struct("offset", F.hex("data").alias("h"))))
    data = F.unhex(F.array_join(F.transform(rows, lambda x: x["h"]), ""))
    return pieces.groupBy("group", "pack").agg(data.alias("data")).withColumn("hash", F.sha2("data", 256))


def extent_overlaps(extents: DataFrame, keys: list[str]) -> DataFrame:
    """Extents that begin before an earlier one of their pack has ended.

    A running maximum of ends over the sorted extents sees every overlap without
    comparing pairs.
    """
    return extents.withColumn("before", _end_before(keys)).where(F.col("offset") < F.col("before"))


def _end_before(keys: list[str]) -> Column:
    """The last end of the extents that begin earlier."""
    w = Window.partitionBy(*keys).orderBy("offset", "shard")
    return F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(Window.unboundedPreceding, -1))


def range_get(objects: DataFrame, data: str, offset, length) -> DataFrame:
    """``part``: bytes [offset, offset + length); null outside the object."""
    fits = (offset >= 0) & (length > 0) & (offset + length <= F.octet_length(data))
    return objects.withColumn("part", F.when(fits, F.substring(F.col(data), (offset + 1).cast("int"), length.cast("int"))))


def unpack(extents: DataFrame, packs: DataFrame) -> DataFrame:
    """Extents with ``part`` and ``ok``: the bytes lie inside the pack and have the digest they should.

    extents: group, pack, shard, offset, length, hash; packs: group, pack, data.
    """
    both = range_get(extents.join(packs.select("group", "pack", "data"), ["group", "pack"], "left"), "data", F.col("offset"), F.col("length"))
    return both.withColumn("ok", F.coalesce(F.sha2("part", 256) == F.col("hash"), F.lit(False))).drop("data")


def extent_violations(extents: DataFrame, group: str = "group") -> DataFrame:
    """(rule, group, shard) of extents (group, pack, shard, offset, length, pack_hash, hash) that break a rule.

    Bounds must not be null or negative and their sum stay within 2^53 - 1, hashes be lower
    hex digests, a shard have one extent in its group, and extents of one pack not overlap.
    An empty extent overlaps what it lies inside of, and none that it only touches. Extents
    are read once: windows stay in a group, and what is known of one row goes along as a flag.
    """
    end = F.col("offset") + F.col("length")
    rules = [
        ("bounds", (F.col("offset") >= 0) & (F.col("length") >= 0) & (F.col("offset") <= 2**53 - 1) & (F.col("length") <= 2**53 - 1) & (end <= 2**53 - 1)),
        ("pack hash", F.col("pack_hash").rlike(DIGEST)),
        ("hash", F.col("hash").rlike(DIGEST)),
    ]
    flags = [ok.alias(f"_{i}") for i, (_, ok) in enumerate(rules)]
    rows = extents.select(group, "shard", "pack_hash", "offset", "length", *flags)
    # a repeated shard is told once, by its second extent
    rows = rows.withColumn("_before", _end_before([group, "pack_hash"])).withColumn("_n", F.row_number().over(Window.partitionBy(group, "shard").orderBy("offset")))
    told = [(name, F.col(f"_{i}")) for i, (name, _) in enumerate(rules)]
    told += [("repeated shard", F.col("_n") != 2), ("overlap", ~F.coalesce(F.col("offset") < F.col("_before"), F.lit(False)))]
    return violations(rows, F.struct(group, "shard"), told).select("rule", "identity.*")


def single_extent(extents: DataFrame, shard) -> DataFrame:
    """The one extent of ``shard`` in a manifest; an error if there is none or more than one. The filter reaches the scan."""
    found = extents.where(F.col("shard") == F.lit(shard))
    n = found.limit(2).count()
    if n != 1:
        raise CatalogError("input", "no extent" if not n else "several extents")
    return found
