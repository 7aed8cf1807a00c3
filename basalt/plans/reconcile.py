"""Reconciling concurrent revisions: union or conflicts, heads, missing parents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from basalt.operators import graph, merge
from basalt.operators.validate import CatalogError, at_most, duplicates, enforce
from basalt.plans.durable import checkpoint, written
from basalt.plans.limits import V1
from basalt.plans.planner import reference_violations, routed
from basalt.sources import ingest


@dataclass
class Reconciliation:
    """``union`` stands for a catalog only if ``conflicts`` is empty; nothing ever wins over another claim."""

    nodes: DataFrame
    union: DataFrame
    conflicts: DataFrame
    heads: DataFrame
    missing_parents: DataFrame
    freshness: str = "unknown"

    def summary(self) -> DataFrame:
        """One row of counts."""
        one = lambda df, name: df.agg(F.count("*").alias(name))
        out = one(self.nodes, "revisions")
        for df, name in ((self.heads, "heads"), (self.missing_parents, "missing_parents"), (self.union, "agreed"), (self.conflicts, "conflicts")):
            out = out.join(one(df, name), F.lit(True))  # one row each
        return out.withColumn("whole", F.col("conflicts") == 0).withColumn("freshness", F.lit(self.freshness))


def reconcile(records: DataFrame, nodes: DataFrame, edges: DataFrame, live: DataFrame | None = None, dead: DataFrame | None = None, limits: dict | None = None) -> Reconciliation:
    """records: kind, identity, body of all revisions; nodes, edges: the revision graph.

    With ``limits`` (V1 of the format) more revisions, locators or bytes of the result are errors.

    live and dead (head, identity, body), if given, add the conflicts of what is alive at one
    head and dead at another. A cycle is an error.
    """
    if not edges.where("child = parent").isEmpty() or not graph.cycle_nodes(edges).isEmpty():
        raise CatalogError("input", "cycle of revisions")
    if limits is not None:
        at_most(nodes, limits["inputs"])
        views = merge.claim_views(records, limits["locators"])
        if merge.result_budget(views, limits["record_overhead"]).first()["bytes"] > limits["result_bytes"]:
            raise CatalogError("limit", "bytes of the result")
    conflicts = merge.identity_conflicts(records).select("conflict", "identity", "n_claims")
    if live is not None and dead is not None:
        found = graph.tombstone_live_conflicts(live, dead, graph.ancestor_closure(edges), nodes)
        conflicts = conflicts.union(found.select(F.lit("tombstone-live"), F.col("identity").cast("string"), "n_claims"))
    return Reconciliation(nodes, merge.merged_union(records), conflicts, graph.heads(nodes, edges), graph.missing_parents(nodes, edges))


#: Rules of a catalog that are bounds; others are about its form.
BOUNDS = ("entries", "observations", "locators")


@dataclass
class CatalogReconciliation:
    """Nothing ever wins over another claim: ``union`` stands for a catalog only if ``conflicts`` is empty."""

    nodes: DataFrame  # node
    union: DataFrame  # kind, identity, body, in no order
    conflicts: DataFrame  # conflict, identity, claims in order
    heads: DataFrame  # node
    missing_parents: DataFrame  # node
    bytes: int  # what the result takes, by the accounting of the format
    whole: bool
    freshness: str = "unknown"

    def catalog(self) -> DataFrame:
        """One row (data): the canonical text of the union, parsed and checked again; no row if anything conflicts.

        One text holds all records, which the limits of the format bound.
        """
        spark = self.nodes.sparkSession
        if not self.whole:
            return spark.createDataFrame([], "data binary")
        entry = F.col("kind") != "observation"
        row = F.struct("kind", "identity", "body")
        listed = lambda which: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, row))), lambda x: x["body"]), ",")
        body = self.union.agg(listed(entry).alias("e"), listed(~entry).alias("o"))
        parents = self.heads.agg(F.array_sort(F.collect_list("node")).alias("p"))
        text = F.concat(F.lit('{"entries":['), "e", F.lit('],"observations":['), "o", F.lit('],"parents":'), F.to_json("p"), F.lit(',"payloadVersion":1}'))
        out = written(body.join(parents, F.lit(True)).select(F.encode(text, "UTF-8").alias("data")), "catalog")  # one row each
        parsed_catalogs(out.select(F.lit("union").alias("revision"), "data"))
        return out


def parsed_catalogs(texts: DataFrame, limits: dict = V1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records: text, revision, kind, identity, package, body; sources: text, revision, digest; edges: child, parent) of full snapshots (revision, data).

    Errors are of the class that they belong to: input, limit, conflict (one catalog, one identity, several claims)
    and reference. Equal records of one catalog count once, and their locators are united: only catalogs
    whose walk found an identity twice have any, so records of the others stay where they were written.
    """
    read = ingest.parse_catalogs(texts, limits)
    broken = checkpoint(read.violations)
    enforce(broken.where(~F.col("rule").isin(*BOUNDS)), "input")
    enforce(broken, "limit")
    records, again = read.records, read.texts.where("repeats").select("text")
    if not again.isEmpty():
        views = merge.claim_views(records.join(again, "text", "left_semi"), limits["locators"], by=["text", "revision"])
        views = written(routed(views).select(*records.columns), "views")
        enforce(duplicates(views, ["text", "kind", "identity"]), "conflict")
        records = written(records.join(again, "text", "left_anti").union(views), "records")
    enforce(reference_violations(records, "text"), "reference")
    return records, read.texts.select("text", "revision", "digest"), read.parents


def concurrent_conflicts(records: DataFrame, heads: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(conflict, identity, claims) of what is alive at one head and dead at another. records: revision, kind, identity, package, body.

    Such a package is a snapshot in some record and the target of a tombstone in another, so only
    claims of packages that are both meet the heads; without snapshots none are.
    """
    kinds = {"snapshot": "identity", "tombstone": "package"}
    of = lambda kind, *more: records.where(F.col("kind") == kind).select(F.col(kinds[kind]).alias("identity"), *more)
    if not of("snapshot").isEmpty():
        met = checkpoint(of("snapshot").distinct().join(of("tombstone").distinct(), "identity", "left_semi"))
        if not met.isEmpty():
            at_heads = heads.select(F.col("node").alias("head"))
            live, dead = (checkpoint(of(kind, F.col("revision").alias("head"), "body", "kind").join(met, "identity", "left_semi").join(at_heads, "head", "left_semi")) for kind in kinds)
            live, dead = (df.select("head", "identity", "body") for df in (merge.in_order(live), dead))
            found = graph.tombstone_live_conflicts(live, dead, graph.ancestor_closure(edges), nodes, bodies=True)
            return checkpoint(found.select(F.lit("tombstone-live").alias("conflict"), "identity", "claims"))
    return records.sparkSession.createDataFrame([], "conflict string, identity string, claims array<string>")


def accounted(texts: DataFrame, column: str, overhead: int) -> DataFrame:
    """One row: bytes of canonical texts, with ``overhead`` for each."""
    return texts.agg(F.coalesce(F.sum(F.octet_length(column) + overhead), F.lit(0)).cast("bigint").alias("bytes"))


def reconcile_catalogs(texts: DataFrame, limits: dict = V1) -> CatalogReconciliation:
    """Concurrent revisions of one catalog from bytes: ``texts`` are revision (digest) and data.

    A digest may come twice with one payload, in any formatting; with two it is a conflict.
    The bytes of the result are accounted for as they come: sources, live and dead
    claims, heads and parents, then the union or the conflicting claims.
    """
    most, overhead, used = limits["result_bytes"], limits["record_overhead"], 0
    at_most(texts, limits["inputs"])
    if texts.isEmpty():
        raise CatalogError("limit", "no revisions")
    enforce(texts.where(~F.coalesce(F.col("revision").rlike("^[0-9a-f]{64}$"), F.lit(False))).select("revision"), "input")

    def account(*parts: tuple[DataFrame, str]) -> None:
        nonlocal used
        for df, column in parts:
            used += accounted(df, column, overhead).first()["bytes"]
            if used > most:
                raise CatalogError("limit", "bytes of the result")

    said = lambda df, c: df.select(F.concat(F.lit('"'), c, F.lit('"')).alias("said"))
    records, sources, edges = parsed_catalogs(texts, limits)
    twice = checkpoint(sources.groupBy("revision").agg(F.min("text").alias("text"), F.count("*").alias("copies"), F.countDistinct("digest").alias("payloads")))
    enforce(twice.where("payloads > 1").select("revision"), "conflict")
    if not twice.where("copies > 1").isEmpty():
        records = written(records.join(twice.select("text"), "text", "left_semi"), "records")
    nodes = twice.select(F.col("revision").alias("node"))
    edges = checkpoint(edges.distinct())
    account((said(nodes, "node"), "said"), (nodes.select(F.lit("1").alias("said")), "said"), (said(edges, "parent"), "said"), (records, "body"))
    if not edges.where("child = parent").isEmpty() or not graph.cycle_nodes(edges).isEmpty():
        raise CatalogError("input", "cycle of revisions")
    heads, missing = checkpoint(graph.heads(nodes, edges)), checkpoint(graph.missing_parents(nodes, edges))
    concurrent = concurrent_conflicts(records, heads, nodes, edges)
    claims = lambda df: df.select(F.explode("claims").alias("body"))
    account((said(concurrent, "conflict"), "said"), (said(concurrent, "identity"), "said"), (claims(concurrent), "body"))
    account((said(heads, "node"), "said"), (said(missing, "node"), "said"), (nodes.limit(1).select(F.lit('"unknown"').alias("said")), "said"))

    every = written(merge.claims(records, limits["locators"]), "claims")
    observed, n = F.col("kind") == "observation", F.size("claims")
    sizes = every.agg(F.sum(F.when(~observed, n)).alias("e"), F.sum(F.when(observed, n)).alias("o")).fillna(0).first()
    if sizes["e"] > limits["entries"] or sizes["o"] > limits["observations"] or heads.count() > limits["parents"]:
        raise CatalogError("limit", "records of the union")
    clashing = every.where(n > 1).select(merge.conflict_name().alias("conflict"), "identity", "claims")
    conflicts = clashing.union(concurrent)
    union = every.where(n == 1).select("kind", "identity", F.col("claims")[0].alias("body"))
    whole = conflicts.isEmpty()
    if whole:
        account((nodes.limit(1).select(F.lit("1").alias("said")), "said"), (said(heads, "node"), "said"), (union, "body"))
    else:
        account((said(clashing, "conflict"), "said"), (said(clashing, "identity"), "said"), (claims(clashing), "body"))
    return CatalogReconciliation(nodes, union, conflicts, heads, missing, used, whole)
