"""Storage layouts of id-keyed records: flat, and by hash bucket with reuse of what didn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basalt.functions.scalars import bucket
from basalt.operators.ordered_digest import ordered_digest, whole_digest
from basalt.operators.validate import at_most
from basalt.plans.durable import checkpoint
from basalt.plans.limits import V2, BUCKETS


def synthetic_records(spark, count: int, seed: str, least: int = 128, most: int = 256) -> DataFrame:
    """(id, payload): deterministic records whose payload has ``least`` to ``most`` bytes."""
    n = spark.range(count).withColumn("id", F.concat(F.lit("rec-"), F.lpad(F.col("id").cast("string"), 8, "0"))).withColumn("n", F.substring("id", 5, 8).cast("bigint"))
    byte = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "id"), 256), 1, 2), 16, 10).cast("int")
    width = F.lit(least) + (F.pmod(byte, F.lit(max(0, most - least) + 1)) if most > least else F.lit(0))
    empty = F.concat(F.lit(f'{{"k":"{seed}","n":'), F.col("n").cast("string"), F.lit(',"pad":""}'))
    pad = F.repeat(F.lit("A"), F.greatest(F.lit(0), width - F.octet_length(empty)))
    return n.select("id", F.concat(F.substring_index(empty, '"}', 1), pad, F.lit('"}')).alias("payload"))


def bucketed(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return records.withColumn("bucket", bucket(F.col("id"), buckets))


def bucket_prints(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, records, fingerprint). A bucket is digested as its records come in order of their ids, whatever its size."""
    return ordered_digest(bucketed(records, buckets), ["bucket"], [F.col("id")], F.col("payload"))


def changed_buckets(parent: DataFrame, child: DataFrame) -> DataFrame:
    """(bucket, state) of bucket prints: reused, changed, added or removed."""
    p = parent.select("bucket", F.col("fingerprint").alias("was"))
    c = child.select("bucket", F.col("fingerprint").alias("now"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") == F.col("now"), "reused").otherwise("changed")
    return p.join(c, "bucket", "full_outer").select("bucket", state.alias("state"))


def write_sharded(records: DataFrame, path: str, parent: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Write buckets under ``path``; with ``parent``, only buckets that changed. Returns the state of each bucket."""
    spark, now = records.sparkSession, checkpoint(bucket_prints(records, buckets))  # one row a bucket, read three times
    was = spark.read.parquet(f"{parent}/manifest") if parent else now.where("false")
    state = changed_buckets(was, now)
    dirty = state.where("state IN ('added', 'changed')").select("bucket")
    out = bucketed(records, buckets).join(F.broadcast(dirty), "bucket")  # at most ``buckets`` rows
    out.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data")
    place = F.lit(path)
    if parent:
        old = was.select("bucket", F.col("place").alias("old"))
        kept = now.join(state, "bucket").join(old, "bucket", "left").select("bucket", "records", "fingerprint", F.when(F.col("state") == "reused", F.col("old")).otherwise(place).alias("place"))
    else:
        kept = now.withColumn("place", place)
    kept.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")  # last, so that no reader sees half a revision
    return state


def read_sharded(spark, path: str) -> DataFrame:
    """All records of a revision, from the places that its manifest names."""
    manifest = [(r["place"], r["bucket"]) for r in spark.read.parquet(f"{path}/manifest").collect()]  # one row a bucket
    out = None
    for place in sorted({p for p, _ in manifest}):
        own = [b for p, b in manifest if p == place]
        part = spark.read.parquet(f"{place}/data").where(F.col("bucket").isin(own)).select("id", "payload", "bucket")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "id string, payload string, bucket int")


def pruned_lookup(table: DataFrame, identity: str, buckets: int = BUCKETS) -> DataFrame:
    """One record from a table partitioned by ``bucket``: the scan reads one partition."""
    return table.where((F.col("bucket") == bucket(F.lit(identity), buckets)) & (F.col("id") == identity))


def misplaced(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Records that don't belong into the ``bucket`` they came from."""
    return records.where(bucket(F.col("id"), buckets) != F.col("bucket"))


def flat_commit(parent: DataFrame, child: DataFrame) -> DataFrame:
    """One row: records, fingerprint, and whether there is nothing to commit.

    The digest of a flat revision is over all its records in order: they are sorted by ranges, but one
    task reads the joined payloads one after another. Use buckets where that takes too long.
    """

    def one(d: DataFrame) -> DataFrame:
        found = whole_digest(d, [F.col("id")], F.col("payload")).withColumn("all", F.lit(0))
        row = d.sparkSession.range(1).select(F.col("id").cast("int").alias("all"))
        return row.join(found, "all", "left").select(F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("fingerprint", F.sha2(F.lit("[]"), 256)).alias("fingerprint"))

    return one(child).join(one(parent).select(F.col("fingerprint").alias("was")), F.lit(True)).select("records", "fingerprint", (F.col("was") == F.col("fingerprint")).alias("no_change"))


def apply_update(records: DataFrame, identity: str, payload) -> DataFrame:
    """A revision with one record's payload replaced."""
    return records.withColumn("payload", F.when(F.col("id") == identity, payload).otherwise(F.col("payload")))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side; none if they are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


def median_range(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("n"))


def trial_summary(trials: DataFrame, group: list[str], value: str, equal: str) -> DataFrame:
    """Median, range, values in order and whether all trials agreed."""
    return trials.groupBy(*group).agg(
        F.median(value).alias("median"), F.min(value).alias("least"), F.max(value).alias("most"),
        F.array_join(F.array_sort(F.collect_list(value)).cast("array<string>"), ",").alias("observed"), F.every(equal).alias("all_equal"),
    )


def store_counters(log: DataFrame) -> DataFrame:
    """(op, role, calls, bytes) of an access log."""
    return log.groupBy("op", "role").agg(F.count("*").alias("calls"), F.sum("bytes").alias("bytes"))


def flat_lookup(table: DataFrame, identity: str) -> DataFrame:
    """One record from a table without buckets: the scan reads all of ``id``, the filter is pushed into it."""
    return table.where(F.col("id") == identity)


def with_epochs(records: DataFrame, epochs: DataFrame, key: str = "epoch", most: int = V2["epochs"]) -> DataFrame:
    """``records`` with the columns of their epoch (or codec); those of unknown ones are null.

    ``epochs`` has one row for each ``key``, at most ``most``: the bound of what is broadcast.
    """
    return records.join(F.broadcast(at_most(epochs, most)), key, "left")
