"""Closed schemas of single records: every nested level, each kind by its own rules.

One table gives each kind its members: what they hold, and the rule that is broken where
they don't. The Spark type of a record and its rules are both made from that table, so a member
that is in one is in the other. A record is (kind, identity, body) with ``body`` in canonical
form. It is read with the type of its kind, whose fields are in sorted order, and
written again with every member, null or not: a text that differs lacks a member, has
one too many or a value of another type. So absent isn't null, and null is refused
wherever the table doesn't allow it. Everything is a DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from basalt.functions.scalars import canonical_json
from basalt.operators.validate import receipt_rules, violations
from basalt.plans import schemas
from basalt.plans.limits import METADATA_BYTES, PACKAGE_BYTES, V1, V2


@dataclass(frozen=True)
class Text:
    """A string that ``pattern`` fits, of at most ``most`` characters; ``null`` tells whether null may stand for it."""

    pattern: str
    most: int | None = None
    null: bool = False
    type = "string"

    def check(self, c: Column) -> Column:
        fine = c.rlike(self.pattern)
        if self.most is not None:
            fine = fine & (F.length(c) <= self.most)
        return c.isNull() | fine if self.null else fine


@dataclass(frozen=True)
class Choice:
    values: tuple[str, ...]
    type = "string"

    def check(self, c: Column) -> Column:
        return c.isin(*self.values)


@dataclass(frozen=True)
class Time:
    type = "string"

    def check(self, c: Column) -> Column:
        return schemas.is_timestamp(c)


@dataclass(frozen=True)
class Number:
    least: int
    most: int

    type = "bigint"

    def check(self, c: Column) -> Column:
        return c.between(self.least, self.most)


@dataclass(frozen=True)
class Members:
    """An object with exactly these members: name -> (rule, what it holds). Inner rules without a name count for the outer one."""

    of: dict[str, tuple[str | None, object]]

    @property
    def type(self) -> str:
        return f"struct<{','.join(f'{name}:{self.of[name][1].type}' for name in sorted(self.of))}>"

    def check(self, c: Column) -> Column:
        return reduce(lambda a, b: a & b, (F.coalesce(holds.check(c[name]), F.lit(False)) for name, (_, holds) in self.of.items()))

    def rules(self, c: Column) -> list[tuple[str, Column]]:
        """(rule, condition): members of one rule make one condition; a rule of its own inside an object goes before the object's."""
        found: dict[str, list[Column]] = {}

        def walk(of: Members, at: Column, outer: str | None) -> None:
            for name, (rule, holds) in of.of.items():
                rule = rule or outer
                if isinstance(holds, Members):
                    walk(holds, at[name], rule)
                else:
                    found.setdefault(rule, []).append(F.coalesce(holds.check(at[name]), F.lit(False)))

        walk(self, c, None)
        return [(rule, reduce(lambda a, b: a & b, all_)) for rule, all_ in found.items()]


@dataclass(frozen=True)
class List:
    """An array of ``least`` to ``most`` different items."""

    item: object
    least: int
    most: int

    @property
    def type(self) -> str:
        return f"array<{self.item.type}>"

    def check(self, c: Column) -> Column:
        n = F.size(c)
        return n.between(self.least, self.most) & (F.size(F.array_distinct(c)) == n) & F.forall(c, lambda x: F.coalesce(self.item.check(x), F.lit(False)))


# The members of records, their choices, patterns and bounds, as the formats give them.
DIGEST, ID16, ID32, TIME = Text(schemas.DIGEST), Text(schemas.ID16), Text(schemas.ID32), Time()
LABEL = r"^[^\x00-\x1f\x7f]*(?![\s\S])"
COMMIT = r"^([0-9a-f]{40}|[0-9a-f]{64})(?![\s\S])"
SCHEME = r"^[a-z][a-z0-9.-]{0,63}(?![\s\S])"
LIFECYCLES = ("prepared", "submitted", "confirmed", "failed", "orphaned", "unassociated")
RETENTIONS = ("irreplaceable-private-state", "retained-application-witness")
TOMBSTONE_REASONS = ("user-request", "superseded", "invalid-capture")
OUTCOME_REASONS = {"authentication-failed": ("aead-rejected",), "not-found": ("object-not-found",), "access-denied": ("permission-denied",), "unavailable": ("network", "provider", "rate-limit")}


def plain(most: int, null: bool = False) -> Text:
    return Text(schemas.PLAIN_TEXT, most, null)


def file_id(most: int, null: bool = False) -> Text:
    return Text(rf"^[A-Za-z0-9_-]{{1,{most}}}(?![\s\S])", None, null)


def place(version: int) -> Members:
    """A locator; the second format has narrower ones."""
    binding = (
        Members({"scheme": (None, Text(SCHEME)), "value": (None, plain(1024))})
        if version == 1
        else Members({"scheme": (None, Choice(("google-drive-permission-id",))), "value": (None, Text(r"^[A-Za-z0-9_.-]{1,128}(?![\s\S])"))})
    )
    most = 1024 if version == 1 else 128
    return Members({"provider": (None, Choice(("google-drive",))), "accountBinding": (None, binding), "objectId": (None, file_id(most)), "revisionId": (None, file_id(most, null=True))})


METADATA = Members(
    {
        "network": ("metadata", Members({"id": (None, plain(128)), "genesisHash": (None, plain(256, null=True))})),
        "accountBinding": ("metadata", Members({"scheme": (None, Text(SCHEME)), "value": (None, plain(1024))})),
        "applicationId": ("metadata", plain(256)),
        "contract": ("metadata", Members({"address": (None, plain(1024)), "codeHash": (None, plain(256, null=True))})),
        "privateStateIds": ("private states", List(plain(256), 1, 256)),
        "codec": (
            "codec",
            Members(
                {
                    "id": (None, plain(256)),
                    "version": (None, Number(1, 2**31 - 1)),
                    "producerPackage": (None, plain(256)),
                    "producerVersion": (None, plain(128)),
                    "sourceCommit": (None, Text(COMMIT)),
                }
            ),
        ),
        "capturedAt": ("captured at", TIME),
        "lifecycle": ("lifecycle", Members({"status": (None, Choice(LIFECYCLES)), "transactionId": (None, plain(256, null=True)), "blockHash": (None, plain(256, null=True))})),
        "parents": ("metadata parents", List(DIGEST, 0, 16)),
        "retentionClass": ("metadata", Choice(RETENTIONS)),
    }
)
PACKAGE = Members(
    {
        "sha256": ("package digest", DIGEST),
        "byteLength": ("package bytes", Number(1, PACKAGE_BYTES)),
        "rootEpoch": ("root epoch", ID16),
        "scopeId": ("package ids", ID32),
        "recordId": ("package ids", ID32),
        "generationId": ("package ids", ID32),
    }
)
TOMBSTONE = Members(
    {"entryKind": ("entry kind", Choice(("tombstone",))), "eventId": ("event id", ID32), "targetPackageSha256": ("target digest", DIGEST), "reason": ("reason", Choice(TOMBSTONE_REASONS)), "recordedAt": ("recorded at", TIME)}
)
RECEIPT = Members(
    {
        "entryKind": ("entry kind", Choice(("root-update-receipt",))),
        "receiptId": ("receipt id", ID32),
        "parentRootRecordSha256": ("parent digests", List(DIGEST, 1, 2)),
        "currentRootRecordSha256": ("current digest", DIGEST),
        "rootRevisionId": ("root revision id", ID32),
        "retainedOldEpochs": ("old epochs", List(ID16, 1, 255)),
        "newActiveEpoch": ("active epoch", ID16),
        "recordedAt": ("recorded at", TIME),
    }
)


class Outcome:
    """What an observation saw: each status has members of its own, and no others."""

    type = "struct<byteLength:bigint,observedSha256:string,reason:string,status:string>"

    def rules(self, c: Column) -> list[tuple[str, Column]]:
        said = c["reason"].isNull()
        for status, reasons in OUTCOME_REASONS.items():
            said = F.when(c["status"] == status, F.coalesce(c["reason"].isin(*reasons), F.lit(False))).otherwise(said)
        return [
            *((f"outcome: {name}", rule) for name, rule in schemas.outcome_rules(c)),
            ("outcome: reason", said),
            ("outcome: bytes", c["byteLength"].isNull() | c["byteLength"].between(1, PACKAGE_BYTES)),
        ]


def kinds(version: int = 1, locators: int | None = None) -> dict[str, Members]:
    """The schema of each kind of record; ``locators`` is the most that a snapshot may have."""
    most = locators if locators is not None else (V1 if version == 1 else V2)["locators"]
    where = place(version)
    snapshot = {"entryKind": ("entry kind", Choice(("snapshot",))), "package": (None, PACKAGE), "metadata": (None, METADATA), "label": ("label", Text(LABEL, 256, null=True)), "locators": ("locators", List(where, 1, most))}
    observation = {"observationId": ("observation id", ID32), "packageSha256": ("package digest", DIGEST), "locator": ("locator", where), "observedAt": ("observed at", TIME)}
    return {"snapshot": Members(snapshot), "tombstone": TOMBSTONE, "root-update-receipt": RECEIPT, "observation": Members(observation)}


#: The type of a locator, whatever the format.
LOCATOR = place(1).type


def _quoted(c: Column) -> Column:
    """JSON of one string or null."""
    all_ = F.to_json(F.array(c))
    return F.substring(all_, F.lit(2), F.length(all_) - 2)


def same_text(kind: str, body: Column, c: Column) -> Column:
    """Whether a record that is written again is its text."""
    if kind != "observation":
        return body == canonical_json(c)
    # members of an outcome depend on its status: null ones aren't written, so they must be absent
    outcome = F.coalesce(F.to_json(c["outcome"]), F.lit("null"))
    before = canonical_json(F.struct(*(c[f].alias(f) for f in ("locator", "observationId", "observedAt"))))
    return body == F.concat(F.left(before, F.length(before) - 1), F.lit(',"outcome":'), outcome, F.lit(',"packageSha256":'), _quoted(c["packageSha256"]), F.lit("}"))


def shape(kind: str, schema: Members) -> str:
    """The Spark type of a kind of record, members in sorted order."""
    fields = {name: holds.type for name, (_, holds) in schema.of.items()} | ({"outcome": Outcome.type} if kind == "observation" else {})
    return f"struct<{','.join(f'{name}:{fields[name]}' for name in sorted(fields))}>"


def rules(kind: str, c: Column, version: int = 1, locators: int | None = None) -> list[tuple[str, Column]]:
    """What holds for a valid record of ``kind``, parsed into ``c``; a null condition is broken."""
    out = kinds(version, locators)[kind].rules(c)
    if kind == "observation":
        out += Outcome().rules(c["outcome"])
    if kind == "root-update-receipt":
        out += receipt_rules(c["parentRootRecordSha256"], c["currentRootRecordSha256"], c["retainedOldEpochs"], c["newActiveEpoch"])
    if kind == "snapshot":
        out.append(("metadata size", F.octet_length(canonical_json(c["metadata"])) <= METADATA_BYTES))
    return out


def record_violations(records: DataFrame, locators: int | None = None, version: int = 1) -> DataFrame:
    """(rule, identity) of records (kind, identity, body) that break the schema of their kind, in the first format or the second.

    ``closed`` are members that are absent, unknown or of another type. One pass for each kind, no shuffle.
    """
    out = None
    for kind, schema in kinds(version, locators).items():
        own = records.where(F.col("kind") == kind).withColumn("c", F.from_json("body", shape(kind, schema)))
        found = violations(own, F.col("identity"), [("closed", same_text(kind, F.col("body"), F.col("c"))), *rules(kind, F.col("c"), version, locators)])
        out = found if out is None else out.union(found)
    known = F.coalesce(F.col("kind").isin(*kinds()), F.lit(False))
    return out.union(records.where(~known).select(F.lit("kind"), "identity"))


def kind_mismatches(records: DataFrame) -> DataFrame:
    """Records whose body names another kind of entry than the record does; observations name none."""
    named = F.get_json_object("body", "$.entryKind")
    return records.where(F.when(F.col("kind") == "observation", named.isNotNull()).otherwise(~named.eqNullSafe(F.col("kind"))))
