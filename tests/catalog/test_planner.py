import hashlib
import json

import pytest
from pyspark.sql import functions as F
from test_records import META, PACKAGE, PLACE2, RECEIPT, SEEN, SNAPSHOT2, TOMBSTONE

from basalt.functions import strict_json as sj
from basalt.operators.validate import CatalogError
from basalt.plans.limits import V2
from basalt.plans.planner import plan_shards
from basalt.sources import ingest

ENDS = "AEIMQUYcgkosw048"


def sha(x):
    return hashlib.sha256(str(x).encode()).hexdigest()


def id32(x):
    import base64

    return base64.urlsafe_b64encode(hashlib.sha256(str(x).encode()).digest()).decode().rstrip("=")


def snapshot(i, **change):
    return {"recordKind": "snapshot", "body": SNAPSHOT2 | {"package": PACKAGE | {"sha256": sha(i)}, "label": f"n{i}"} | change}


def observation(i, of, **change):
    return {"recordKind": "observation", "body": SEEN | {"observationId": id32(("o", i)), "packageSha256": sha(of), "locator": PLACE2} | change}


def tombstone(i, of):
    return {"recordKind": "tombstone", "body": TOMBSTONE | {"eventId": id32(("t", i)), "targetPackageSha256": sha(of)}}


def identity(r):
    b = r["body"]
    return b["package"]["sha256"] if "package" in b else b.get("eventId") or b.get("receiptId") or b["observationId"]


def brute(records, most, target):
    """Leaves by splitting, breadth first: prefix -> canonical text, or None for an empty one."""
    rows = sorted((sha(json.dumps(["WPP/catalog-route/v2", r["recordKind"], identity(r)], separators=(",", ":"))), r["recordKind"], identity(r), sj.canonical(r)) for r in records)
    queue, out = [("", rows)], {}
    while queue:
        prefix, own = queue.pop(0)
        text = f'{{"nodeType":"shard","partitionVersion":1,"payloadVersion":2,"prefix":"{prefix}","records":[{",".join(r[3] for r in own)}]}}' if own else None
        if len(own) < 2 or (len(own) <= most and len(text.encode()) <= target):
            out[prefix] = text
        else:
            queue += [(prefix + d, [r for r in own if r[0].startswith(prefix + d)]) for d in "0123456789abcdef"]
    return out


def texts(spark, *arrays):
    return spark.createDataFrame([(str(i), (a if isinstance(a, bytes) else sj.canonical(a).encode())) for i, a in enumerate(arrays)], "revision string, data binary")


def test_equals_brute_force_and_parses_back(spark):
    records = [snapshot(i) for i in range(60)] + [observation(i, i % 60) for i in range(90)] + [tombstone(i, i) for i in range(0, 60, 7)] + [{"recordKind": "root-update-receipt", "body": RECEIPT}]
    small = V2 | {"records_per_leaf": 9, "shard_target": 9000}
    plan = plan_shards(texts(spark, records[:100], records[100:], []), small)
    want = brute(records, 9, 9000)
    assert {r.prefix: r.payload and bytes(r.payload).decode() for r in plan.leaves.collect()} == want and len(want) > 16
    row = plan.totals.first()
    live = {sha(i) for i in range(60) if i % 7}
    assert (row.entries, row.observations, row.epochs, row.live, row.live_bytes, row.leaves) == (60 + 9 + 1, 90, 1, len(live), 3 * len(live), len(want))
    assert row.bytes == sum(len(t.encode()) for t in want.values() if t) and {r.digest for r in plan.live.collect()} == live
    # what was planned parses back to what was given
    back, broken = ingest.parse_shards(plan.leaves.where("NOT empty").select(F.lit("r").alias("revision"), F.col("prefix").alias("shard"), F.col("payload").alias("data")), small)
    assert broken.count() == 0
    assert sorted((r.kind, r.body) for r in back.collect()) == sorted((r["recordKind"], sj.canonical(r["body"])) for r in records)
    for r in plan.leaves.where("NOT empty").collect():
        held = json.loads(bytes(r.payload))["records"]
        assert r.entries + r.observations == len(held) and r.fingerprint == hashlib.sha256(sj.canonical(held).encode()).hexdigest()


def test_nothing_and_one(spark):
    for records in ([], [snapshot(1)]):
        plan = plan_shards(texts(spark, records))
        assert {r.prefix: r.payload and bytes(r.payload).decode() for r in plan.leaves.collect()} == brute(records, 1024, 1 << 18)
        assert plan.totals.first().leaves == 1 and plan.totals.first().entries == len(records)


def refused(spark, code, *arrays, **limits):
    with pytest.raises(CatalogError) as e:
        plan_shards(texts(spark, *arrays), V2 | limits)
    assert e.value.code == code, e.value


def test_errors_have_their_class_and_drop_nothing(spark):
    one = snapshot(1)
    refused(spark, "input", json.dumps([one]).encode())
    refused(spark, "input", sj.canonical({"a": [one]}).encode())
    refused(spark, "input", [one | {"more": 1}])
    refused(spark, "input", [snapshot(1, metadata=META | {"retentionClass": "other"})])
    refused(spark, "conflict", [one, snapshot(1, label="other")])
    refused(spark, "conflict", [one], [one])
    refused(spark, "reference", [one, observation(1, 2)])
    refused(spark, "reference", [one, observation(1, 1, locator=PLACE2 | {"objectId": "elsewhere"})])
    refused(spark, "reference", [one, observation(1, 1, outcome={"status": "digest-mismatch", "observedSha256": sha(1)})])
    many = [snapshot(i) for i in range(20)]
    refused(spark, "limit", many, entries=19)
    refused(spark, "limit", many + [observation(i, 1) for i in range(3)], observations=2)
    refused(spark, "limit", many, live_bytes=59)
    refused(spark, "limit", many, records_per_leaf=2, references=16)
    refused(spark, "limit", many, total_shard_bytes=10_000)
    refused(spark, "limit", [snapshot(1)], shard_bytes=500)
    assert plan_shards(texts(spark, many), V2 | {"entries": 20, "live_bytes": 60}).totals.first().entries == 20
