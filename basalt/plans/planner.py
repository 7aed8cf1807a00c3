"""Planning shards: from canonical arrays of records to canonical shard texts that parse back."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions import scalars as fn
from basalt.operators import shards, validate
from basalt.operators.validate import CatalogError
from basalt.plans import schemas
from basalt.plans.durable import checkpoint, written
from basalt.plans.limits import V2
from basalt.sources import ingest

#: Where the identity of a record stands, and what it refers to.
PLACES = ("$.package.sha256", "$.eventId", "$.receiptId", "$.observationId")
# Locators as JSON texts: bodies are canonical, so equal places are equal texts.
SNAPSHOT = "struct<package:struct<byteLength:bigint,rootEpoch:string>,locators:array<string>>"
OBSERVATION = f"struct<locator:string,outcome:{schemas.OUTCOME}>"


def routed(records: DataFrame) -> DataFrame:
    """records (kind, body, ...) with identity, package (what an observation or a tombstone refers to), route and bytes (of its tagged text)."""
    at = [F.get_json_object("body", p) for p in PLACES]
    identity = fn.selected_identity(F.col("kind"), *at)
    package = F.when(F.col("kind") == "observation", F.get_json_object("body", "$.packageSha256")).when(F.col("kind") == "tombstone", F.get_json_object("body", "$.targetPackageSha256"))
    out = records.withColumns({"identity": identity, "package": package})
    return out.withColumns({"route": fn.route_hash(F.col("kind"), F.col("identity")), "bytes": F.octet_length(record_text()).cast("bigint")})


def record_text() -> Column:
    """The tagged text of a record (kind, body)."""
    return F.concat(F.lit('{"body":'), "body", F.lit(',"recordKind":"'), "kind", F.lit('"}'))


def shard_text(prefix: Column, records: Column) -> Column:
    """Canonical text of a shard node; ``records`` are the tagged texts of its records, comma-separated."""
    return F.concat(F.lit('{"nodeType":"shard","partitionVersion":1,"payloadVersion":2,"prefix":"'), prefix, F.lit('","records":['), records, F.lit("]}"))


@dataclass
class State:
    """What a set of records holds together, for each of its groups."""

    totals: DataFrame  # group, entries, observations, epochs, live, live_bytes
    epochs: DataFrame  # group, epoch: those of its snapshots
    live: DataFrame  # group, digest, byte_length: snapshots without a tombstone
    violations: DataFrame  # rule, group


def _sides(records: DataFrame, group: str) -> tuple[DataFrame, DataFrame, Column]:
    """Snapshots and observations of records (``group``, kind, identity, package, body) with what their rules read, and the key of what a record refers to."""
    key = F.struct(group, F.coalesce("package", "identity").alias("package"))
    s = records.where("kind = 'snapshot'").select(group, F.struct(group, F.col("identity").alias("package")).alias("key"), F.col("identity").alias("digest"), F.from_json("body", SNAPSHOT).alias("s"))
    s = s.select(group, "key", "digest", F.coalesce("s.package.byteLength", F.lit(-1)).alias("bytes"), F.col("s.package.rootEpoch").alias("epoch"), F.coalesce("s.locators", F.array().cast("array<string>")).alias("locators"))
    o = records.where("kind = 'observation'").select(group, "identity", key.alias("key"), F.from_json("body", OBSERVATION).alias("o"))
    o = o.select(group, "identity", "key", F.col("o.locator").alias("locator"), F.col("o.outcome.status").alias("status"), F.coalesce("o.outcome.observedSha256", F.lit("")).alias("observed"), F.coalesce("o.outcome.byteLength", F.lit(-2)).alias("length"))
    return s, o, key


def _references(s: DataFrame, o: DataFrame, group: str) -> DataFrame:
    say = lambda df, rule: df.select(F.lit(rule).alias("rule"), group)
    broken = say(validate.dangling(o, s, "key"), "dangling observation").union(say(validate.outside_locators(o, s, "key", "locator", "locators"), "unlisted locator"))
    wrong = validate.outcome_violations(o.withColumn("identity", F.col(group)), s, "key")
    return broken.union(wrong.select(F.concat(F.lit("outcome: "), "rule"), F.col("identity")))


def reference_violations(records: DataFrame, group: str) -> DataFrame:
    """(rule, group) of observations whose snapshot isn't in their group, lies at other places or was seen otherwise. Only snapshots and observations are read."""
    s, o, _ = _sides(records, group)
    return _references(s, o, group)


def revision_state(records: DataFrame, group: str, limits: dict = V2) -> State:
    """records: ``group``, kind, identity, package, body. Each identity once, observations of snapshots at their places, bounds of a revision.

    Groups are revisions side by side; every join and sum is by group and key, so none is gathered.
    """
    s, o, key = _sides(records, group)
    dead = records.where("kind = 'tombstone'").select(key.alias("key")).distinct()
    broken = validate.duplicates(records, [group, "kind", "identity"]).select(F.lit("repeated identity").alias("rule"), group).union(_references(s, o, group))
    epochs = s.select(group, "epoch").distinct()
    live = s.join(dead, "key", "left_anti").select(group, "digest", F.col("bytes").alias("byte_length"))
    entry = F.col("kind") != "observation"
    totals = records.groupBy(group).agg(F.count_if(entry).alias("entries"), F.count_if(~entry).alias("observations"))
    totals = totals.join(epochs.groupBy(group).agg(F.count("*").alias("epochs")), group, "left").join(live.groupBy(group).agg(F.count("*").alias("live"), F.sum("byte_length").alias("live_bytes")), group, "left").fillna(0)
    over = [("entries", "entries"), ("observations", "observations"), ("epochs", "epochs"), ("live_bytes", "live_bytes")]
    bounds = validate.violations(totals, F.col(group), [(f"capacity: {c}", F.col(c) <= limits[limit]) for c, limit in over])
    return State(totals, epochs, live, broken.union(bounds).distinct())


@dataclass
class Plan:
    leaves: DataFrame  # prefix, empty, payload, bytes, entries, observations, fingerprint; the last five null for empty ones
    totals: DataFrame  # one row: entries, observations, epochs, live, live_bytes, bytes, leaves
    live: DataFrame  # digest, byte_length


def plan_shards(texts: DataFrame, limits: dict = V2) -> Plan:
    """Leaves of canonical arrays of records (revision, data), which together are one catalog.

    Anything that breaks a rule is an error of the class it belongs to, and no record is dropped:
    input (texts and records), conflict (an identity twice), reference (what observations
    refer to) and limit. Splits of the trie end where a leaf holds at most ``records_per_leaf``
    records and ``shard_target`` bytes, or one record of at most ``shard_bytes``.
    """
    parsed, broken = ingest.parse_records(texts, limits, routed)
    validate.enforce(broken, "input")
    records = parsed.drop("revision").withColumn("all", F.lit(0))
    if records.count() > limits["records"]:
        raise CatalogError("limit", f"more than {limits['records']} records")
    state = revision_state(records, "all", limits)
    found = checkpoint(state.violations)
    validate.enforce(found.where("rule = 'repeated identity'"), "conflict")
    validate.enforce(found.where("rule NOT LIKE 'capacity: %'"), "reference")
    validate.enforce(found, "limit")
    leaves = checkpoint(shards.adaptive_leaves(records, limits["records_per_leaf"], limits["shard_target"]))
    if leaves.count() > limits["references"]:
        raise CatalogError("limit", f"more than {limits['references']} references")
    # a leaf's records are bounded by the limits of a leaf
    own = shards.assign_leaves(records, leaves.where("n > 0"))
    entry = F.col("kind") != "observation"
    all_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("route", "kind", "identity", record_text().alias("record")))), lambda x: x["record"]), ",")
    full = own.groupBy("prefix").agg(all_.alias("records"), F.count_if(entry).alias("entries"), F.count_if(~entry).alias("observations"))
    payload = F.encode(shard_text(F.col("prefix"), F.col("records")), "UTF-8")
    full = full.select("prefix", payload.alias("payload"), "entries", "observations", F.sha2(F.concat(F.lit("["), "records", F.lit("]")), 256).alias("fingerprint")).withColumn("bytes", F.octet_length("payload").cast("bigint"))
    full = written(full, "leaves")
    validate.enforce(full.where(F.col("bytes") > limits["shard_bytes"]).select("prefix", "bytes"), "limit")
    total = full.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    if total.first()["bytes"] > limits["total_shard_bytes"]:
        raise CatalogError("limit", "bytes of all shards")
    names = ("entries", "observations", "epochs", "live", "live_bytes")
    sums = state.totals.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names))
    summary = sums.join(total, F.lit(True)).join(leaves.agg(F.count("*").alias("leaves")), F.lit(True))  # one row each
    every = leaves.select("prefix", (F.col("n") == 0).alias("empty")).join(full, "prefix", "left")
    return Plan(every.select("prefix", "empty", "payload", "bytes", "entries", "observations", "fingerprint"), summary, state.live.drop("all"))
