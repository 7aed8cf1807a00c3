"""Closed schemas of catalog records, as Spark types and as rules.

A rule is (name, condition that holds for valid rows). ``violations`` in
``basalt.operators.validate`` turns rules into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LOCATOR = "struct<provider:string,accountBinding:struct<scheme:string,value:string>,objectId:string,revisionId:string>"
PACKAGE = "struct<sha256:string,byteLength:bigint,rootEpoch:string,scopeId:string,recordId:string,generationId:string>"
METADATA = (
    "struct<network:struct<id:string,genesisHash:string>,accountBinding:struct<scheme:string,value:string>,applicationId:string,"
    "contract:struct<address:string,codeHash:string>,privateStateIds:array<string>,"
    "codec:struct<id:string,version:int,producerPackage:string,producerVersion:string,sourceCommit:string>,capturedAt:string,"
    "lifecycle:struct<status:string,transactionId:string,blockHash:string>,parents:array<string>,retentionClass:string>"
)
#: All three entry kinds; fields of the other kinds are null.
ENTRY = (
    f"struct<entryKind:string,package:{PACKAGE},metadata:{METADATA},label:string,locators:array<{LOCATOR}>,eventId:string,targetPackageSha256:string,"
    "reason:string,recordedAt:string,receiptId:string,parentRootRecordSha256:array<string>,currentRootRecordSha256:string,rootRevisionId:string,"
    "retainedOldEpochs:array<string>,newActiveEpoch:string>"
)
OUTCOME = "struct<status:string,observedSha256:string,byteLength:bigint,reason:string>"
OBSERVATION = f"struct<observationId:string,packageSha256:string,locator:{LOCATOR},observedAt:string,outcome:{OUTCOME}>"
CATALOG = f"struct<payloadVersion:int,parents:array<string>,entries:array<{ENTRY}>,observations:array<{OBSERVATION}>>"
REFERENCE = (
    "struct<prefix:string,empty:boolean,recordId:string,generationId:string,rootEpoch:string,wireSha256:string,wireByteLength:bigint,"
    f"plaintextByteLength:bigint,entryCount:bigint,observationCount:bigint,canonicalRecordsSha256:string,locators:array<{LOCATOR}>>"
)
ROOT = (
    "struct<payloadVersion:int,nodeType:string,partitionVersion:int,parents:array<string>,entryCount:bigint,observationCount:bigint,"
    f"requiredEpochs:array<string>,references:array<{REFERENCE}>>"
)

# The grammars of identifiers. ``(?![\s\S])`` ends a text where ``$`` would let a line feed pass.
DIGEST = r"^[0-9a-f]{64}(?![\s\S])"
ID16 = r"^[A-Za-z0-9_-]{21}[AQgw](?![\s\S])"
ID32 = r"^[A-Za-z0-9_-]{42}[AEIMQUYcgkosw048](?![\s\S])"
HEX_PREFIX = r"^[0-9a-f]{0,64}(?![\s\S])"
TIMESTAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?Z(?![\s\S])"
PLAIN_TEXT = r"^[^\x00-\x1f\x7f]+(?![\s\S])"
STATUSES = ("readback-authenticated", "digest-mismatch", "authentication-failed", "not-found", "access-denied", "unavailable")


def is_timestamp(c: Column) -> Column:
    """A UTC time with up to three fraction digits, on a day that exists."""
    return F.coalesce(c.rlike(TIMESTAMP) & F.try_to_timestamp(c).isNotNull(), F.lit(False))


def unique_within(c: Column, most: int) -> Column:
    return (F.size(c) <= most) & (F.size(F.array_distinct(c)) == F.size(c))


def outcome_rules(outcome: Column) -> list[tuple[str, Column]]:
    """Which fields each outcome has, and no others."""
    status = outcome["status"]
    has = lambda f: outcome[f].isNotNull()
    return [
        ("status", F.coalesce(status.isin(*STATUSES), F.lit(False))),
        ("observed digest", (status.isin(*STATUSES[:2]) == has("observedSha256")) & F.coalesce(outcome["observedSha256"].rlike(DIGEST), F.lit(True))),
        ("byte length", (status == STATUSES[0]) == has("byteLength")),
    ]
