"""Merging concurrent revisions by identity, keeping every conflicting claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions.scalars import canonical_json
from basalt.operators.records import LOCATOR
from basalt.operators.validate import enforce

#: The kind of conflict that differing bodies of a record kind make.
CONFLICTS = {"snapshot": "snapshot-claim", "tombstone": "event-claim", "root-update-receipt": "receipt-claim", "observation": "observation-claim"}
LOCATORS = '"locators":'  # as it stands in a canonical body


def _located(records: DataFrame) -> DataFrame:
    """``records`` with _held, the locators of a snapshot, _text, what they are in its body, and _placed: whether that stands there.

    ``body`` is canonical, so ``"locators":`` and the list after it stand in it once: quotes inside its strings are
    escaped. Locators that break their schema aren't there.
    """
    # read with their type and written again, so that their text is the one in the body, whatever characters it holds
    out = records.withColumn("_held", F.when(F.col("kind") == "snapshot", F.from_json("body", f"struct<locators:array<{LOCATOR}>>")["locators"]))
    out = out.withColumn("_text", F.concat(F.lit(LOCATORS), canonical_json(F.col("_held"))))
    return out.withColumn("_placed", F.coalesce(F.contains("body", "_text"), F.lit(False)))


def _united(records: DataFrame, most: int | None, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Claims (``by``, kind, identity, body) without locators, as often as they come, and with the locators of all that make one claim, once each."""
    known = _located(records.select(*by, "kind", "identity", "body"))
    cut = known.where((F.col("kind") == "snapshot") & F.col("_placed")).withColumn("core", F.replace(F.col("body"), F.col("_text"), F.lit(LOCATORS)))
    each = cut.select(*by, "kind", "identity", "core", F.explode_outer("_held").alias("locator")).withColumn("locator", canonical_json(F.col("locator")))
    united = each.groupBy(*by, "kind", "identity", "core").agg(F.array_sort(F.collect_set("locator")).alias("locators"))
    if most is not None:
        enforce(united.where(F.size("locators") > most).select("identity"), "limit")
    body = F.replace(F.col("core"), F.lit(LOCATORS), F.concat(F.lit(LOCATORS + "["), F.array_join("locators", ","), F.lit("]")))
    return known.where(~F.col("_placed")).select(*by, "kind", "identity", "body"), united.select(*by, "kind", "identity", body.alias("body"))


def claim_views(records: DataFrame, most: int | None = None, by: list[str] | None = None) -> DataFrame:
    """(kind, identity, body), once each: the union of all revisions given, or of each group ``by``, whose columns come first.

    Two snapshots that differ only in their locators make one claim, with the locators of
    both, each once and in order. The shuffle carries each distinct body once per task. With ``most``, more locators are an error.
    """
    by = by or []
    others, united = _united(records.select(*by, "kind", "identity", "body").distinct(), most, by)
    return others.union(united)


def claims(records: DataFrame, most: int | None = None) -> DataFrame:
    """(kind, identity, claims): all of ``claim_views`` that an identity has, in order.

    Records are shuffled once, by identity; snapshots once more, with their locators.
    """
    others, united = _united(records, most, [])
    # identities first, as sorting goes by the beginning of the first key
    every = others.union(united).groupBy("identity", "kind").agg(F.array_sort(F.collect_set("body")).alias("claims"))
    return every.select("kind", "identity", "claims")


def in_order(records: DataFrame) -> DataFrame:
    """``records`` whose snapshots have their locators in order, each once, as ``claim_views`` gives a snapshot that comes alone."""
    sorted_ = F.array_join(F.array_sort(F.array_distinct(F.transform("_held", canonical_json))), ",")
    body = F.replace("body", F.col("_text"), F.concat(F.lit(LOCATORS + "["), sorted_, F.lit("]")))
    return _located(records).withColumn("body", F.when(F.col("_placed"), body).otherwise(F.col("body"))).select(*records.columns)


def conflict_name() -> Column:
    """The kind of conflict that several claims of a record's ``kind`` make."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in CONFLICTS.items() for x in kv)), F.col("kind"))


def identity_conflicts(records: DataFrame) -> DataFrame:
    """(conflict, identity, n_claims, claims): identities with several bodies, claims in order."""
    g = claim_views(records).groupBy("kind", "identity").agg(F.count("*").alias("n_claims"), F.array_sort(F.collect_list("body")).alias("claims"))
    return g.where("n_claims > 1").select(conflict_name().alias("conflict"), "identity", "n_claims", "claims")


def merged_union(records: DataFrame) -> DataFrame:
    """(kind, identity, body) of identities on which all revisions agree; only whole if nothing conflicts."""
    g = claim_views(records).groupBy("kind", "identity").agg(F.count("*").alias("n"), F.min("body").alias("body"))
    return g.where("n = 1").drop("n")


def locator_union(claims: DataFrame, key: str, locators: str) -> DataFrame:
    """(key, locators): all places of equal claims, each once, in order."""
    each = claims.select(key, F.explode(locators).alias("locator")).distinct()
    return each.groupBy(key).agg(F.array_sort(F.collect_list("locator")).alias("locators"))


def revision_dedupe(revisions: DataFrame) -> DataFrame:
    """(revision, payload, copies, conflict): one digest with several payloads is a conflict."""
    g = revisions.groupBy("revision").agg(F.min("payload").alias("payload"), F.max("payload").alias("last"), F.count("*").alias("copies"))
    return g.select("revision", "payload", "copies", (F.col("payload") != F.col("last")).alias("conflict"))


def result_budget(records: DataFrame, overhead: int = 64) -> DataFrame:
    """One row: records and what they take, ``overhead`` bytes each besides their bodies."""
    return records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("body") + overhead), F.lit(0)).cast("bigint").alias("bytes"))


def ordered(records: DataFrame) -> DataFrame:
    """By kind, identity, body."""
    return records.orderBy("kind", "identity", "body")
