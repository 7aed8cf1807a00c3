"""Parsing catalogs and catalog nodes into tables.

Input is (revision string, data binary). A text is refused by the strict JSON walk first;
accepted ones are read with a closed schema. Nothing is coerced, defaulted or inferred:
fields beyond the schema, missing fields and broken bounds are violations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions import strict_json as sj
from basalt.functions.scalars import canonical_json
from basalt.operators.records import DIGEST, ID16, ID32, List, Members, Number, Text, kind_mismatches, place, record_violations
from basalt.operators.shards import cover_violations
from basalt.operators.validate import violations
from basalt.plans import schemas
from basalt.plans.durable import written
from basalt.plans.limits import METADATA_BYTES, PLAINTEXT_BYTES, V1, V2

# The fields of each kind of text.
CATALOG_FIELDS = ("payloadVersion", "parents", "entries", "observations")
ROOT_FIELDS = ("payloadVersion", "nodeType", "partitionVersion", "parents", "entryCount", "observationCount", "requiredEpochs", "references")
SHARD_FIELDS = ("payloadVersion", "nodeType", "partitionVersion", "prefix", "records")
SHARD = "struct<payloadVersion:int,nodeType:string,partitionVersion:int,prefix:string>"


@dataclass
class Catalogs:
    texts: DataFrame  # text (a number), revision, digest (of its canonical form; null if refused), repeats: whether an identity comes twice
    parents: DataFrame  # child, parent
    records: DataFrame  # text, revision, kind, identity, package (what an observation or a tombstone refers to), body
    entries: DataFrame  # revision, kind, identity, entry, body: from the texts again, where ``records`` are read from what was written
    observations: DataFrame  # revision, identity, observation, body: likewise
    violations: DataFrame  # rule, identity (of the revision)


def _exactly(text: Column, fields: tuple[str, ...]) -> Column:
    return F.array_sort(F.json_object_keys(text)) == F.array(*(F.lit(f) for f in sorted(fields)))


def walked(texts: DataFrame, most: int, walk: Callable[[Column], Column]) -> DataFrame:
    """``texts`` with refusal (null for one that is fine), same (whether it is canonical) and what else ``walk`` tells of it."""
    large = F.octet_length("data") > most
    state = texts.withColumn("_state", walk(F.when(~large, F.col("data"))))
    more = [F.col(f"_state.{f}").alias(f) for f in state.schema["_state"].dataType.names if f != "refusal"]
    return state.select(*texts.columns, F.when(large, "too-large").otherwise(F.col("_state.refusal")).alias("refusal"), *more)


def opened(texts: DataFrame, most: int, walk: Callable[[Column], Column] = sj.json_state) -> DataFrame:
    """``texts`` with text and what ``walked`` adds; as they are, if they were opened before.

    They are written, as rules, records and sums each read them: a text is made and walked once.
    """
    if {"text", "refusal", "same"} <= set(texts.columns):
        return texts
    return written(walked(texts, most, walk), "texts").withColumn("text", F.col("data").cast("string"))


def opened_shards(texts: DataFrame, limits: dict = V2) -> DataFrame:
    """``texts`` of shard nodes, opened, with the records that they hold."""
    return opened(texts, limits["shard_bytes"], sj.shard_records)


def parse_catalogs(texts: DataFrame, limits: dict = V1, most: int = PLAINTEXT_BYTES) -> Catalogs:
    """Full snapshots (payload version 1), with bounds checked before anything else is.

    One walk checks a text and gives its records, which are written: bodies are kept as they came, in canonical
    form, so that equal claims are equal texts. What holds of a text stands with its first record, or with none.
    """
    own = walked(texts.select("revision", "data"), most, sj.catalog_records)
    told = [f for f in sj.CATALOG.names if f != "records"]
    every = own.withColumn("text", F.monotonically_increasing_id()).select("text", "revision", F.struct(*told).alias("head"), F.posexplode_outer("records").alias("position", "r"))
    head = F.when(F.coalesce("position", F.lit(0)) == 0, F.col("head"))
    every = written(every.select("text", "revision", head.alias("head"), "r.*", F.col("position").isNotNull().alias("held")), "records")
    heads = written(every.where("head IS NOT NULL").select("text", "revision", "head.*"), "catalogs")
    records = every.where("held").select("text", "revision", "kind", "identity", "package", "body")
    fine, c = heads.where("refusal IS NULL"), F.col
    rules = [
        ("fields", F.array_sort("fields") == F.array(*(F.lit(f) for f in sorted(CATALOG_FIELDS)))),
        ("version", c("version") == 1),
        ("parents", schemas.unique_within(c("parents"), limits["parents"]) & F.forall(c("parents"), lambda p: p.rlike(schemas.DIGEST))),
        ("entries", c("entries") <= limits["entries"]),
        ("observations", c("observations") <= limits["observations"]),
        ("observation repeats", c("observed") == c("observations")),
        ("locators", c("locators") <= limits["locators"]),
        ("metadata size", c("metadata") <= METADATA_BYTES),
    ]
    broken = violations(fine, c("revision"), rules).union(heads.where("refusal IS NOT NULL").select(F.concat(F.lit("json: "), "refusal"), "revision"))
    # every nested level is closed, by the rules of the record's kind
    nested = record_violations(records.select("kind", c("revision").alias("identity"), "body"), limits["locators"]).select(F.concat(F.lit("record: "), "rule"), "identity")
    n, o = (F.coalesce(f, F.lit(0)) for f in ("entries", "observations"))
    each = lambda some: own.select("revision", F.explode(some).alias("r"))
    typed = lambda name, schema: F.from_json("r.body", schema).alias(name)
    return Catalogs(
        heads.select("text", "revision", "digest", "repeats"),
        fine.select(c("revision").alias("child"), F.explode("parents").alias("parent")),
        records,
        each(F.slice("records", F.lit(1), n)).select("revision", "r.kind", "r.identity", typed("entry", schemas.ENTRY), "r.body"),
        each(F.slice("records", n + 1, o)).select("revision", "r.identity", typed("observation", schemas.OBSERVATION), "r.body"),
        broken.union(nested.distinct()),
    )


def _references(version: int = 2) -> Members:
    """What a reference to a shard that isn't empty holds; one to an empty prefix has ``empty`` and ``prefix`` alone."""
    return Members(
        {
            "prefix": ("prefix", Text(schemas.HEX_PREFIX)),
            "recordId": ("ids", ID32),
            "generationId": ("ids", ID32),
            "rootEpoch": ("epoch", ID16),
            "wireSha256": ("wire digest", DIGEST),
            "wireByteLength": ("wire bytes", Number(1, V2["shard_wire_bytes"])),
            "plaintextByteLength": ("bytes", Number(1, V2["shard_bytes"])),
            "entryCount": ("counts", Number(0, V2["records_per_leaf"])),
            "observationCount": ("counts", Number(0, V2["records_per_leaf"])),
            "canonicalRecordsSha256": ("records digest", DIGEST),
            "locators": ("locators", List(place(version), 1, V2["locators"])),
        }
    )


def reference_violations(references: DataFrame, limits: dict = V2) -> DataFrame:
    """(rule, identity) of references (identity, body) of root manifests; ``body`` is canonical."""
    schema = _references()
    fields = {name: holds.type for name, (_, holds) in schema.of.items()} | {"empty": "boolean"}
    c = F.from_json("body", f"struct<{','.join(f'{n}:{fields[n]}' for n in sorted(fields))}>")
    rows = references.withColumn("c", c)
    blank = F.coalesce(F.col("c.empty"), F.lit(False))
    bare = canonical_json(F.struct(F.col("c.empty").alias("empty"), F.col("c.prefix").alias("prefix")))
    records, size = F.col("c.entryCount") + F.col("c.observationCount"), F.col("c.plaintextByteLength")
    budget = F.when(records == 1, limits["shard_bytes"]).otherwise(limits["shard_target"])
    rules = [
        ("reference: closed", F.when(blank, F.col("body") == bare).otherwise((F.col("body") == canonical_json(F.col("c"))) & F.col("c.empty").isNotNull())),
        *((f"reference: {name}", rule if name == "prefix" else blank | rule) for name, rule in schema.rules(F.col("c"))),
        ("reference: records", blank | records.between(1, limits["records_per_leaf"])),
        ("reference: budget", blank | F.coalesce(size <= budget, F.lit(True))),
    ]
    return violations(rows, F.col("identity"), rules)


def parse_roots(texts: DataFrame, limits: dict = V2) -> tuple[DataFrame, DataFrame]:
    """(references, violations) of root manifests; a root must be in canonical form."""
    own = opened(texts, limits["root_bytes"])
    fine = own.where("refusal IS NULL").withColumn("c", F.from_json("text", schemas.ROOT))
    c = lambda f: F.col(f"c.{f}")
    refs = c("references")
    total = lambda f: F.aggregate(refs, F.lit(0).cast("bigint"), lambda a, r: a + F.coalesce(r[f], F.lit(0)))
    # strictly ascending: each once and in order
    sorted_ = lambda x: x == F.array_sort(F.array_distinct(x))
    rules = [
        ("canonical", F.col("same")),
        ("fields", _exactly(F.col("text"), ROOT_FIELDS)),
        ("role", (c("payloadVersion") == 2) & (c("nodeType") == "root") & (c("partitionVersion") == 1)),
        ("parents", (F.size(c("parents")) <= limits["parents"]) & sorted_(c("parents")) & F.forall(c("parents"), lambda p: p.rlike(schemas.DIGEST))),
        ("epochs", (F.size(c("requiredEpochs")) <= limits["epochs"]) & sorted_(c("requiredEpochs")) & F.forall(c("requiredEpochs"), lambda e: e.rlike(schemas.ID16))),
        ("references", (F.size(refs) >= 1) & (F.size(refs) <= limits["references"])),
        ("order", sorted_(F.transform(refs, lambda r: r["prefix"]))),
        ("reference epoch", F.forall(refs, lambda r: r["empty"] | F.array_contains(c("requiredEpochs"), r["rootEpoch"]))),
        ("counts", c("entryCount").between(0, limits["entries"]) & c("observationCount").between(0, limits["observations"])),
        ("entries", total("entryCount") == c("entryCount")),
        ("observations", total("observationCount") == c("observationCount")),
        ("shard bytes", total("plaintextByteLength") <= limits["total_shard_bytes"]),
    ]
    broken = violations(fine, F.col("revision"), rules).union(own.where("refusal IS NOT NULL").select(F.concat(F.lit("json: "), "refusal"), "revision"))
    raw = fine.select("revision", F.explode(F.from_json("text", "struct<references:array<variant>>")["references"]).alias("r"))
    nested = reference_violations(raw.select(F.col("revision").alias("identity"), sj.json_canonical(F.encode(F.to_json("r"), "UTF-8")).alias("body")), limits)
    return fine.select("revision", F.explode("c.references").alias("r")).select("revision", "r.*"), broken.union(nested.distinct())


@dataclass
class Preflight:
    references: DataFrame  # revision and the members of each reference
    totals: DataFrame  # revision, entries, observations, bytes, shards: sums over its references
    violations: DataFrame  # rule, identity (of the revision)


def preflight_roots(texts: DataFrame, limits: dict = V2) -> Preflight:
    """Root manifests (revision, data) checked before any shard is read, all in one pass.

    Besides the rules of a root and of each reference, prefixes must cover the whole range
    without gaps or overlaps.
    """
    refs, broken = parse_roots(texts, limits)
    refs = written(refs, "references")
    cover = cover_violations(refs.select("revision", "prefix"), group=["revision"]).select(F.concat(F.lit("cover: "), "rule").alias("rule"), F.col("revision").alias("identity"))
    held = ~F.col("empty")
    add = lambda c: F.coalesce(F.sum(F.when(held, F.col(c))), F.lit(0)).cast("bigint")
    totals = refs.groupBy("revision").agg(
        add("entryCount").alias("entries"), add("observationCount").alias("observations"), add("plaintextByteLength").alias("bytes"), F.count_if(held).alias("shards")
    )
    return Preflight(refs, totals, broken.union(cover.distinct()))


def _tagged(records: DataFrame, limits: dict) -> DataFrame:
    """Violations of records (revision, kind, body, closed, ...): each names its kind and has a body of that kind, and nothing else."""
    tagged = violations(records, F.col("revision"), [("record: fields", F.col("closed"))])
    own = records.select("kind", F.col("revision").alias("identity"), "body")
    nested = record_violations(own, limits["locators"], version=2).union(kind_mismatches(own).select(F.lit("named kind"), "identity"))
    return tagged.union(nested.select(F.concat(F.lit("record: "), "rule"), "identity"))


def parse_shards(texts: DataFrame, limits: dict = V2, more: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records: revision, prefix, position, kind, body; violations) of shard nodes.

    ``texts`` may have a column ``shard`` that tells those of a revision apart, which records
    then have too. Each record must name its kind and have a body, and nothing else; the body is held
    against the closed schema of its kind in the second format, and must name that kind itself. ``more`` may add columns to records.
    Records are written with those: each kind's rules and all that follows read them.
    """
    own = opened_shards(texts, limits)
    fine = own.where("refusal IS NULL").withColumn("c", F.from_json("text", SHARD))
    c = lambda f: F.col(f"c.{f}")
    n = F.size("records")
    budget = F.when(n == 1, limits["shard_bytes"]).otherwise(limits["shard_target"])
    rules = [
        ("canonical", F.col("same")),
        ("fields", _exactly(F.col("text"), SHARD_FIELDS)),
        ("role", (c("payloadVersion") == 2) & (c("nodeType") == "shard") & (c("partitionVersion") == 1)),
        ("prefix", c("prefix").rlike(schemas.HEX_PREFIX)),
        ("records", (n >= 1) & (n <= limits["records_per_leaf"])),
        ("budget", F.octet_length("data") <= budget),
    ]
    broken = violations(fine, F.col("revision"), rules).union(own.where("refusal IS NOT NULL").select(F.concat(F.lit("json: "), "refusal"), "revision"))
    kept = [x for x in ("revision", "shard") if x in texts.columns]
    each = fine.select(*kept, F.col("c.prefix").alias("prefix"), F.posexplode("records").alias("position", "r")).select(*kept, "prefix", "position", "r.*")
    parsed = written(more(each) if more else each, "records")
    return parsed.drop("closed"), broken.union(_tagged(parsed, limits)).distinct()


def parse_records(texts: DataFrame, limits: dict = V2, more: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records: revision, kind, body; violations) of canonical arrays of records (revision, data), which plans are made from.

    Records are written as the one walk gives them, with the columns that ``more`` adds; what
    holds of a text stands with its first record, or with none where it has no records.
    """
    own = walked(texts.select("revision", "data"), limits["plan_bytes"], sj.array_records)
    n = F.when(F.col("records").isNotNull(), F.size("records"))
    each = own.select("revision", "refusal", "same", n.alias("n"), F.posexplode_outer("records").alias("position", "r"))
    each = each.select("revision", "refusal", "same", "n", "position", "r.*")
    every = written(more(each) if more else each, "records")
    text = every.where("position IS NULL OR position = 0")
    rules = [("canonical", F.col("same")), ("array", F.col("n").isNotNull()), ("records", F.coalesce("n", F.lit(0)) <= limits["records"])]
    broken = violations(text.where("refusal IS NULL"), F.col("revision"), rules).union(text.where("refusal IS NOT NULL").select(F.concat(F.lit("json: "), "refusal"), "revision"))
    parsed = every.where("position IS NOT NULL").drop("refusal", "same", "n", "position")
    return parsed.drop("closed"), broken.union(_tagged(parsed, limits)).distinct()
