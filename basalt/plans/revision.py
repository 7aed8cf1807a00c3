"""Validation of a whole sharded revision: all violations of its manifest, shards and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from basalt.operators import shards, validate
from basalt.operators.ordered_digest import ordered_digest
from basalt.plans import schemas
from basalt.plans.limits import V2
from basalt.plans.planner import record_text, revision_state, routed
from basalt.sources import ingest

# Locators as JSON texts: bodies are canonical, so equal places are equal texts.
SNAPSHOT_CLAIMS = "struct<package:struct<byteLength:bigint>,locators:array<string>>"
OBSERVATION_CLAIMS = f"struct<locator:string,outcome:{schemas.OUTCOME}>"


def revision_violations(references: DataFrame, records: DataFrame, required: DataFrame, known: DataFrame) -> DataFrame:
    """(rule, identity).

    references: prefix, entries, observations, bytes, fingerprint. records: prefix, route,
    kind, identity, body (canonical JSON, from which locators and outcomes are read), and
    package (what an observation or a tombstone refers to, else null). required and known:
    epoch.
    """
    say = lambda df, rule, identity: df.select(rule.alias("rule"), identity.cast("string").alias("identity"))
    cover = shards.cover_violations(references.select("prefix"))
    content = shards.reconcile(references, shards.shard_summary(records))
    twice = validate.duplicates(records, ["kind", "identity"])
    snapshots = records.where("kind = 'snapshot'").select(F.col("identity").alias("key"), F.from_json("body", SNAPSHOT_CLAIMS).alias("s"))
    # a claim that is missing equals nothing
    snapshots = snapshots.select(
        "key",
        F.col("key").alias("digest"),
        F.coalesce("s.package.byteLength", F.lit(-1)).alias("bytes"),
        F.coalesce("s.locators", F.array().cast("array<string>")).alias("locators"),
    )
    observed = records.where("kind = 'observation'").select("identity", F.col("package").alias("key"), F.from_json("body", OBSERVATION_CLAIMS).alias("o"))
    observed = observed.select(
        "identity",
        "key",
        F.col("o.locator").alias("locator"),
        F.col("o.outcome.status").alias("status"),
        F.coalesce("o.outcome.observedSha256", F.lit("")).alias("observed"),
        F.coalesce("o.outcome.byteLength", F.lit(-2)).alias("length"),
    )
    lost = validate.dangling(observed, snapshots, "key")
    outside = validate.outside_locators(observed, snapshots, "key", "locator", "locators")
    outcomes = validate.outcome_violations(observed, snapshots, "key")
    epochs = validate.missing_and_extra(required, known, "epoch")
    out = say(cover, F.concat(F.lit("cover: "), "rule"), F.col("prefix"))
    for part in (
        say(shards.misplaced(records), F.lit("misplaced"), F.col("identity")),
        say(content, F.concat(F.lit("manifest: "), "rule"), F.col("prefix")),
        say(twice, F.lit("repeated identity"), F.col("identity")),
        say(lost, F.lit("dangling observation"), F.col("identity")),
        say(outside, F.lit("unlisted locator"), F.col("identity")),
        say(outcomes, F.concat(F.lit("outcome: "), "rule"), F.col("identity")),
        say(epochs.where("side = 'missing'"), F.lit("epoch"), F.col("epoch")),
    ):
        out = out.unionByName(part)
    extra = epochs.where("side = 'extra'").agg(F.count("*").alias("n"), F.max("epoch").alias("epoch")).where("n > 1")
    return out.unionByName(say(extra, F.lit("epochs beyond one"), F.col("epoch")))


@dataclass
class Revisions:
    violations: DataFrame  # rule, identity (of the revision)
    totals: DataFrame  # revision, entries, observations, epochs, live, live_bytes
    live: DataFrame  # revision, digest, byte_length
    first_over: DataFrame  # revision, position, length, used: the shard that goes over the bytes that its root declares


def validate_revisions(roots: DataFrame, nodes: DataFrame, limits: dict = V2) -> Revisions:
    """Whole sharded revisions from bytes, many side by side.

    roots: revision, data; nodes: revision, position, data, the shards of each revision in
    turn. Manifests, shards and records are held to their schemas, shards to the references of
    their root, and records to each other. Violations are complete: a revision is valid
    if it has none. Orders and digests are of single shards, which the limits bound; all
    else goes by keys.
    """
    roots = ingest.opened(roots, limits["root_bytes"])
    pre = ingest.preflight_roots(roots, limits)
    refs = pre.references
    nodes = ingest.opened_shards(nodes.select("revision", F.col("position").alias("shard"), "data", F.octet_length("data").cast("bigint").alias("length")), limits)
    records, broken = ingest.parse_shards(nodes, limits, routed)
    nodes = nodes.select("revision", "shard", "length")
    say = lambda df, rule, by="revision": df.select(rule if not isinstance(rule, str) else F.lit(rule).alias("rule"), F.col(by).alias("identity"))

    # as many shards, and as many bytes in turn, as the root declares
    declared = pre.totals.select("revision", F.col("shards").alias("n"), "bytes")
    budget = F.least(F.coalesce("bytes", F.lit(0)), F.lit(limits["total_shard_bytes"]))
    first = shards.over_budget(nodes.join(declared, "revision", "left"), "revision", "shard", "length", budget).withColumnRenamed("shard", "position")
    sent = nodes.groupBy("revision").agg(F.count("*").alias("sent"), F.sum("length").alias("length"))
    both = declared.join(sent, "revision", "full_outer")
    out = say(first, "over budget")
    same = lambda a, b: F.coalesce(a, F.lit(0)) == F.coalesce(b, F.lit(0))
    out = out.union(validate.violations(both, F.col("revision"), [("no root", F.col("n").isNotNull()), ("number of shards", same("n", "sent")), ("bytes of shards", same("bytes", "length"))]))

    # in a shard: strictly ascending, and of its prefix
    w = Window.partitionBy("revision", "shard").orderBy("position")
    key = F.struct("route", "kind", "identity")
    turned = records.withColumns({"key": key, "before": F.lag(key).over(w)})
    out = out.union(say(turned.where("before >= key"), "order in a shard")).union(say(shards.misplaced(records), "misplaced record"))

    # shards against references
    entry = (F.col("kind") != "observation").cast("int")
    held = ordered_digest(records, ["revision", "shard", "prefix"], [F.col("position")], record_text(), {"entries": entry, "observations": 1 - entry}).drop("records")
    held = held.join(nodes.select("revision", "shard", F.col("length").alias("bytes")), ["revision", "shard"])
    told = refs.where("NOT empty").select(
        F.struct("revision", "prefix").alias("prefix"), F.col("entryCount").alias("entries"), F.col("observationCount").alias("observations"), F.col("plaintextByteLength").alias("bytes"), F.col("canonicalRecordsSha256").alias("fingerprint")
    )
    twice = validate.duplicates(held, ["revision", "prefix"])
    differ = shards.reconcile(told, held.select(F.struct("revision", "prefix").alias("prefix"), "entries", "observations", "bytes", "fingerprint"))
    out = out.union(say(twice, "repeated shard")).union(say(differ, F.concat(F.lit("manifest: "), "rule").alias("rule"), "prefix.revision"))

    # records against each other, and against the totals and epochs that the root declares
    state = revision_state(records, "revision", limits)
    declared = roots.select("revision", F.from_json("text", "struct<entryCount:bigint,observationCount:bigint,requiredEpochs:array<string>>").alias("c"))
    sums = declared.select("revision", "c.*").join(state.totals, "revision", "left").fillna(0, ["entries", "observations"])
    told = [("entries of records", F.col("entries").eqNullSafe(F.col("entryCount"))), ("observations of records", F.col("observations").eqNullSafe(F.col("observationCount")))]
    out = out.union(validate.violations(sums, F.col("revision"), told))
    known = state.epochs.union(refs.where("NOT empty").select("revision", F.col("rootEpoch").alias("epoch"))).where("epoch IS NOT NULL").distinct()
    required = declared.select("revision", F.explode("c.requiredEpochs").alias("epoch")).distinct()
    missing = known.join(required, ["revision", "epoch"], "left_anti")
    extra = required.join(known, ["revision", "epoch"], "left_anti").groupBy("revision").agg(F.count("*").alias("n")).where("n > 1")
    out = out.union(say(missing, "epoch")).union(say(extra, "epochs beyond one"))
    out = out.union(say(state.violations, F.col("rule"))).union(pre.violations).union(broken)
    return Revisions(out.distinct(), state.totals, state.live, first)
