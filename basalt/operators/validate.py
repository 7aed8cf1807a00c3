"""Validators: each gives violation rows (rule, identity); ``enforce`` raises on any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T


class CatalogError(ValueError):
    """``code`` names the class of the error: input, limit, reference, conflict or binding."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


def violations(rows: DataFrame, identity: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """A row for each rule that a row breaks; a null condition is broken. One pass, no shuffle."""
    # nulls go after the array is taken apart: with a lambda that drops them none of the rules would be compiled
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules))
    return rows.select(F.explode(broken).alias("rule"), identity.alias("identity")).where("rule IS NOT NULL")


def enforce(found: DataFrame, code: str) -> None:
    first = found.limit(1).collect()
    if first:
        raise CatalogError(code, str(first[0].asDict()))


def at_most(rows: DataFrame, most: int, code: str = "limit") -> DataFrame:
    """``rows``, or an error if there are more; never fewer rows."""
    if rows.limit(most + 1).count() > most:
        raise CatalogError(code, f"more than {most} rows")
    return rows


def receipt_rules(parents: Column, current: Column, old: Column, new: Column) -> list[tuple[str, Column]]:
    return [
        ("parents repeat", F.size(F.array_distinct(parents)) == F.size(parents)),
        ("own parent", ~F.array_contains(parents, current)),
        ("old epochs repeat", F.size(F.array_distinct(old)) == F.size(old)),
        ("active epoch is old", ~F.array_contains(old, new)),
    ]


def dangling(observations: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Observations of packages that no snapshot has."""
    return observations.join(snapshots.select(key).distinct(), key, "left_anti")


def outside_locators(observations: DataFrame, snapshots: DataFrame, key: str, locator: str, locators: str) -> DataFrame:
    """Observations made at a place that their snapshot doesn't list."""
    both = observations.join(snapshots.select(key, locators), key)
    return both.where(~F.array_contains(locators, F.col(locator))).drop(locators)


def outcome_violations(observations: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    """Read-backs with another digest or length, and mismatches with the same digest.

    observations: key, identity, status, observed, length; snapshots: key, digest, bytes.
    """
    read, differs = F.col("status") == "readback-authenticated", F.col("status") == "digest-mismatch"
    # other outcomes break no rule and don't move; of a status one bit does, of a digest its 32 bytes
    asked = observations.where(read | differs).select(key, "identity", read.alias("_read"), _packed("observed"), "length")
    both = asked.join(snapshots.select(key, _packed("digest"), "bytes"), key)
    read, same = F.col("_read"), F.col("observed") == F.col("digest")
    rule = F.when(read & ~same, "digest").when(read & (F.col("length") != F.col("bytes")), "length").when(~read & same, "same digest")
    return both.withColumn("rule", rule).where("rule IS NOT NULL").select("identity", "rule")


def _packed(digest: str) -> Column:
    """Bytes that are equal where the texts are; a hex digest takes 32, any other text more."""
    c = F.col(digest)
    whole = (F.length(c) == 64) & c.rlike("^[0-9a-f]{64}$")
    return F.when(whole, F.unhex(c)).otherwise(F.concat(F.lit(b"-" * 33), F.encode(c, "UTF-8"))).alias(digest)


def claim_mismatches(claims: DataFrame, opened: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, mismatches): the fields in which a claim differs from what was opened; null equals null."""
    o = opened.select(key, *(F.col(f).alias(f"__{f}") for f in fields))
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in fields)))
    return claims.join(o, key).select(key, F.array_join(differs, ",").alias("mismatches")).where("mismatches <> ''")


def not_one_active(epochs: DataFrame, group: str, epoch: str, active: str) -> DataFrame:
    """Groups whose epochs repeat or that don't have exactly one active epoch."""
    g = epochs.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(epoch).alias("different"), F.count_if(active).alias("n_active"))
    return g.where("n <> different OR n_active <> 1")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_and_extra(required: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key, side): known but not required is ``missing``; required but not known is ``extra``."""
    r, k = required.select(key).distinct(), known.select(key).distinct()
    missing = k.join(r, key, "left_anti").withColumn("side", F.lit("missing"))
    return missing.union(r.join(k, key, "left_anti").withColumn("side", F.lit("extra")))


def covers_epochs(required: DataFrame, known: DataFrame, key: str) -> bool:
    """All known epochs are required, and at most one more."""
    sides = {r["side"]: r["count"] for r in missing_and_extra(required, known, key).groupBy("side").count().collect()}
    return not sides.get("missing") and sides.get("extra", 0) <= 1


def codec_violations(rows: DataFrame, identity: Column, codec: Column, content: Column, policies: dict) -> DataFrame:
    """Run the registered check of each row's codec; unknown codecs are violations.

    ``policies`` maps a codec id to a pandas UDF (or any function of a column) that gives
    the name of a broken rule or null.
    """
    checks = [F.when(codec == name, check(content)) for name, check in policies.items()]
    known = codec.isin(*policies) if policies else F.lit(False)
    rule = F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown codec")).otherwise(reduce(lambda a, b: F.coalesce(a, b), checks, F.lit(None).cast("string")))
    return rows.select(rule.alias("rule"), identity.alias("identity")).where("rule IS NOT NULL")


def binding_mismatches(opened: DataFrame, expected: DataFrame, key: str, column: str = "metadata") -> DataFrame:
    """(key, path): the members in which what was opened isn't what was expected.

    ``expected`` has ``column`` too, a struct of any part of the members: a member that its
    type lacks may be anything, one that it has must be equal, and null is equal to null
    only. A member expected that the opened type doesn't know is a mismatch, as is an
    expectation of something that wasn't opened, with the path ``column`` itself.
    """
    want, have = expected.schema[column].dataType, opened.schema[column].dataType
    both = expected.select(key, F.col(column).alias("_want"), F.lit(True).alias("_asked")).join(opened.select(key, F.col(column).alias("_have"), F.lit(True).alias("_opened")), key, "left")

    def leaves(w: Column, h: Column | None, kind: T.DataType, here: T.DataType | None, path: str) -> list[tuple[str, Column]]:
        if isinstance(kind, T.StructType) and isinstance(here, T.StructType):
            known = {f.name: f.dataType for f in here.fields}
            out = [(path, F.when(w.isNull() | h.isNull(), w.isNull() & h.isNull()).otherwise(F.lit(True)))]
            for f in kind.fields:
                there = known.get(f.name)
                inner = leaves(w[f.name], h[f.name] if there is not None else None, f.dataType, there, f"{path}.{f.name}")
                out += [(p, w.isNull() | h.isNull() | ok) for p, ok in inner]
            return out
        mixed = isinstance(kind, T.StructType) or isinstance(here, T.StructType)
        return [(path, F.lit(False) if here is None or mixed else w.eqNullSafe(h))]

    rules = leaves(F.col("_want"), F.col("_have"), want, have, column)
    rules[0] = (column, F.col("_opened").isNotNull() & rules[0][1])
    rules[1:] = [(p, F.col("_opened").isNull() | ok) for p, ok in rules[1:]]
    return violations(both, F.col(key), rules).select(F.col("identity").alias(key), F.col("rule").alias("path"))
