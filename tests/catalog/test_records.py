import json

import pytest
from pyspark.sql import functions as F

from basalt.functions import strict_json as sj
from basalt.operators import merge, packs, records
from basalt.operators.validate import CatalogError

SHA, ID, EPOCH = "a" * 64, "A" * 42 + "E", "A" * 21 + "A"
PLACE = {"provider": "google-drive", "accountBinding": {"scheme": "s", "value": "v"}, "objectId": "o", "revisionId": None}
META = {
    "network": {"id": "n", "genesisHash": None}, "accountBinding": {"scheme": "s", "value": "v"}, "applicationId": "app", "contract": {"address": "x", "codeHash": None}, "privateStateIds": ["p"],
    "codec": {"id": "c", "version": 1, "producerPackage": "p", "producerVersion": "1", "sourceCommit": "c" * 40}, "capturedAt": "2026-01-01T00:00:00Z",
    "lifecycle": {"status": "confirmed", "transactionId": None, "blockHash": None}, "parents": [], "retentionClass": "retained-application-witness",
}
PACKAGE = {"sha256": SHA, "byteLength": 3, "rootEpoch": EPOCH, "scopeId": ID, "recordId": ID, "generationId": ID}
SNAPSHOT = {"entryKind": "snapshot", "package": PACKAGE, "metadata": META, "label": 'say "locators":[] or not', "locators": [PLACE]}
TOMBSTONE = {"entryKind": "tombstone", "eventId": ID, "targetPackageSha256": SHA, "reason": "superseded", "recordedAt": "2026-01-01T00:00:00.5Z"}
RECEIPT = {"entryKind": "root-update-receipt", "receiptId": ID, "parentRootRecordSha256": ["b" * 64], "currentRootRecordSha256": SHA, "rootRevisionId": ID, "retainedOldEpochs": ["B" * 21 + "A"], "newActiveEpoch": EPOCH, "recordedAt": "2026-01-01T00:00:00Z"}
SEEN = {"observationId": ID, "packageSha256": SHA, "locator": PLACE, "observedAt": "2026-01-01T00:00:00Z", "outcome": {"status": "not-found", "reason": "object-not-found"}}

PLACE2 = PLACE | {"accountBinding": {"scheme": "google-drive-permission-id", "value": "v.1"}}
SNAPSHOT2 = SNAPSHOT | {"locators": [PLACE2]}
#: Members for which null may stand.
NULLABLE = {"label", "locators.0.revisionId", "locator.revisionId", "metadata.network.genesisHash", "metadata.contract.codeHash", "metadata.lifecycle.transactionId", "metadata.lifecycle.blockHash"}


def at(value, path=""):
    """(path, value) of every member and item."""
    for k, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield f"{path}{k}", v
        yield from at(v, f"{path}{k}.")


def changed(value, path, to):
    """``value`` with what lies at ``path`` replaced, or gone for ``to`` of None in a list."""
    out = json.loads(json.dumps(value))
    *way, last = path.split(".")
    holder = out
    for step in way:
        holder = holder[int(step) if isinstance(holder, list) else step]
    if to is None:
        del holder[last]
    else:
        holder[int(last) if isinstance(holder, list) else last] = to[0]
    return out


def broken_rules(spark, cases, **more):
    df = spark.createDataFrame([(kind, name, sj.canonical(body)) for name, (kind, body) in cases.items()], "kind string, identity string, body string").repartition(4)
    found = {name: set() for name in cases}
    for r in records.record_violations(df, **more).collect():
        found[r.identity].add(r.rule)
    return found


@pytest.mark.parametrize("version", [1, 2])
def test_every_member_is_required_typed_and_alone(spark, version):
    read = SEEN | {"outcome": {"status": "readback-authenticated", "observedSha256": SHA, "byteLength": 3}}
    fine = {"snapshot": SNAPSHOT2, "tombstone": TOMBSTONE, "root-update-receipt": RECEIPT, "observation": read | {"locator": PLACE2}}
    cases, nulls = {f"fine {k}": (k, b) for k, b in fine.items()}, {}
    for kind, body in fine.items():
        for path, value in at(body):
            item = path.rpartition(".")[2].isdigit()
            if not item:
                cases[f"absent {kind} {path}"] = (kind, changed(body, path, None))
            nulls[f"null {kind} {path}"] = (kind, changed(body, path, [None]))
            for wrong in ([{"zone": 1}] if isinstance(value, (list, str)) else ["1"] if isinstance(value, int) else [[]]):
                cases[f"type {kind} {path}"] = (kind, changed(body, path, [wrong]))
            if isinstance(value, dict):
                cases[f"more {kind} {path}"] = (kind, changed(body, path, [value | {"zone": None}]))
            if isinstance(value, str):
                cases[f"line {kind} {path}"] = (kind, changed(body, path, [value + "\n"]))
                cases[f"long {kind} {path}"] = (kind, changed(body, path, ["a" * 1025]))
        cases[f"more {kind}"] = (kind, body | {"zone": None})
    found = broken_rules(spark, cases | nulls, version=version)
    assert not any(found[name] for name in found if name.startswith("fine"))
    assert [name for name in cases if not found[name] and not name.startswith("fine")] == []
    assert {name.split()[-1] for name in nulls if not found[name]} == NULLABLE
    assert all("closed" in found[name] for name in cases if name.split()[0] in ("absent", "more") and "absent observation outcome." not in name)  # an outcome's own rules say what it lacks


def test_bounds_of_snapshots(spark):
    meta = lambda **change: ("snapshot", SNAPSHOT | {"metadata": META | change})
    code = lambda **change: meta(codec=META["codec"] | change)
    spot = lambda **change: ("snapshot", SNAPSHOT | {"locators": [PLACE | change]})
    sha = lambda n: [f"{i:064x}" for i in range(n)]
    cases = {
        "16 parents": (meta(parents=sha(16)), set()), "17 parents": (meta(parents=sha(17)), {"metadata parents"}), "same parents": (meta(parents=["b" * 64] * 2), {"metadata parents"}),
        "no states": (meta(privateStateIds=[]), {"private states"}), "256 states": (meta(privateStateIds=sha(256)), set()), "257 states": (meta(privateStateIds=sha(257)), {"private states"}),
        "empty state": (meta(privateStateIds=[""]), {"private states"}), "class": (meta(retentionClass="standard"), {"metadata"}), "class and line": (meta(retentionClass="irreplaceable-private-state\n"), {"metadata"}),
        "network": (meta(network={"id": "", "genesisHash": "g"}), {"metadata"}), "genesis": (meta(network={"id": "n", "genesisHash": ""}), {"metadata"}), "account": (meta(accountBinding={"scheme": "s", "value": ""}), {"metadata"}),
        "transaction": (meta(lifecycle=META["lifecycle"] | {"transactionId": ""}), {"lifecycle"}), "block": (meta(lifecycle=META["lifecycle"] | {"blockHash": "b" * 257}), {"lifecycle"}), "64": (code(sourceCommit="0" * 64), set()),
        "41": (code(sourceCommit="0" * 41), {"codec"}), "upper": (code(sourceCommit="A" * 40), {"codec"}), "version 0": (code(version=0), {"codec"}), "version 2^31": (code(version=2**31), {"codec"}), "version 1.5": (code(version=1.5), {"closed", "codec"}),
        "revision": (spot(revisionId="a/b \n"), {"locators"}), "revision 1024": (spot(revisionId="r" * 1024, objectId="o" * 1024), set()), "revision 1025": (spot(revisionId="r" * 1025), {"locators"}),
        "wide": (meta(applicationId="\U0001f600" * 256), set()), "wider": (meta(applicationId="\U0001f600" * 257), {"metadata"}), "control": (meta(applicationId="a\x7f"), {"metadata"}), "quote": (meta(applicationId='"\\/\u2028é'), set()),
        "big": (meta(privateStateIds=["é" * 150 + f"{i:05}" for i in range(250)]), {"metadata size"}), "label 256": (("snapshot", SNAPSHOT | {"label": "é" * 256}), set()), "label 257": (("snapshot", SNAPSHOT | {"label": "é" * 257}), {"label"}),
        "no locators": (("snapshot", SNAPSHOT | {"locators": []}), {"locators"}), "no epochs": (("root-update-receipt", RECEIPT | {"retainedOldEpochs": []}), {"old epochs"}),
        "outcome null": (("observation", SEEN | {"outcome": SEEN["outcome"] | {"byteLength": None}}), {"closed"}), "outcome more": (("observation", SEEN | {"outcome": SEEN["outcome"] | {"zone": 1}}), {"closed"}),
        "no outcome": (("observation", SEEN | {"outcome": None}), {"outcome: status", "outcome: observed digest", "outcome: byte length"}),
    }
    assert broken_rules(spark, {name: case for name, (case, _) in cases.items()}) == {name: rules for name, (_, rules) in cases.items()}


def test_each_rule_has_a_hostile_case(spark):
    cases = {
        "fine": ("snapshot", SNAPSHOT, set()), "no label": ("snapshot", SNAPSHOT | {"label": None}, set()), "dead": ("tombstone", TOMBSTONE, set()), "receipt": ("root-update-receipt", RECEIPT, set()), "seen": ("observation", SEEN, set()),
        "nested": ("snapshot", SNAPSHOT | {"package": PACKAGE | {"more": 1}}, {"closed"}), "digest": ("snapshot", SNAPSHOT | {"package": PACKAGE | {"sha256": "A" * 64}}, {"package digest"}),
        "text": ("snapshot", SNAPSHOT | {"package": PACKAGE | {"byteLength": "3"}}, {"closed", "package bytes"}), "kind": ("snapshot", SNAPSHOT | {"entryKind": "other"}, {"entry kind"}),
        "twice": ("snapshot", SNAPSHOT | {"locators": [PLACE, PLACE]}, {"locators"}), "bare": ("snapshot", SNAPSHOT | {"metadata": None}, {"metadata", "codec", "captured at", "lifecycle", "metadata parents", "private states", "metadata size"}),
        "epoch": ("snapshot", SNAPSHOT | {"package": PACKAGE | {"rootEpoch": "x"}}, {"root epoch"}), "label": ("snapshot", SNAPSHOT | {"label": "\n"}, {"label"}), "place": ("observation", SEEN | {"locator": PLACE | {"provider": "disk"}}, {"locator"}),
        "length": ("observation", SEEN | {"outcome": {"status": "not-found", "reason": "object-not-found", "byteLength": 3}}, {"outcome: byte length"}),
        "reason": ("observation", SEEN | {"outcome": {"status": "not-found", "reason": "network"}}, {"outcome: reason"}), "said": ("observation", SEEN | {"entryKind": "snapshot"}, {"closed"}),
        "own": ("root-update-receipt", RECEIPT | {"parentRootRecordSha256": [SHA]}, {"own parent"}), "three": ("root-update-receipt", RECEIPT | {"parentRootRecordSha256": [c * 64 for c in "bcd"]}, {"parent digests"}),
        "day": ("tombstone", TOMBSTONE | {"recordedAt": "2026-02-30T00:00:00Z"}, {"recorded at"}), "none": ("letter", {}, {"kind"}),
    }
    df = spark.createDataFrame([(k, i, sj.canonical(b)) for i, (k, b, _) in cases.items()], "kind string, identity string, body string")
    found = {i: set() for i in cases}
    for r in records.record_violations(df).collect():
        found[r.identity].add(r.rule)
    assert found == {i: rules for i, (*_, rules) in cases.items()}
    assert {r.identity for r in records.kind_mismatches(df).collect()} == {"kind", "said", "none"}


def test_snapshots_in_other_places_are_one_claim(spark):
    there = PLACE | {"objectId": "a"}
    rows = [("snapshot", "i", SNAPSHOT), ("snapshot", "i", SNAPSHOT | {"locators": [there, PLACE]}), ("snapshot", "j", SNAPSHOT), ("snapshot", "j", SNAPSHOT | {"label": "other"}), ("tombstone", "i", TOMBSTONE)]
    df = spark.createDataFrame([(k, i, sj.canonical(b)) for k, i, b in rows], "kind string, identity string, body string")
    got = {(r.kind, r.identity): json.loads(r.body) for r in merge.merged_union(df).collect()}
    assert got == {("snapshot", "i"): SNAPSHOT | {"locators": [there, PLACE]}, ("tombstone", "i"): TOMBSTONE}
    assert [(r.conflict, r.identity, r.n_claims) for r in merge.identity_conflicts(df).collect()] == [("snapshot-claim", "j", 2)]
    many = [("snapshot", "i", sj.canonical(SNAPSHOT | {"locators": [PLACE | {"objectId": str(k)}]})) for k in range(17)]
    df = spark.createDataFrame(many, "kind string, identity string, body string")
    assert merge.claim_views(df).count() == 1 and merge.claim_views(df.limit(16), 16).count() == 1
    with pytest.raises(CatalogError, match="limit"):
        merge.claim_views(df, 16)


def test_claims_with_any_characters_are_one(spark):
    wide = "\U0001f600 é \u2028 \\ \" / end"
    here, there = (PLACE | {"accountBinding": {"scheme": "s", "value": wide}, "objectId": o} for o in "ab")
    odd = SNAPSHOT | {"label": wide, "metadata": META | {"applicationId": wide}}
    rows = [odd | {"locators": [here]}, odd | {"locators": [there]}, odd | {"locators": [there, here]}]
    df = spark.createDataFrame([("snapshot", "i", sj.canonical(b)) for b in rows] + [("snapshot", "alone", sj.canonical(rows[0]))], "kind string, identity string, body string")
    assert merge.identity_conflicts(df).count() == 0
    got = {r.identity: r.body for r in merge.claim_views(df).collect()}
    assert got == {"i": sj.canonical(odd | {"locators": [here, there]}), "alone": sj.canonical(rows[0])}


def test_hostile_extents(spark):
    rows = [(1, 0, 1, 0, 10), (1, 0, 2, 10, 5), (1, 0, 3, 14, 1), (1, 0, 4, -1, 1), (1, 1, 5, 2**53 - 2, 4), (1, 1, 6, 0, 1), (1, 2, 6, 0, 1), (1, 3, 7, None, 1)]
    df = spark.createDataFrame(rows, "group int, pack int, shard int, offset bigint, length bigint").withColumn("pack_hash", F.sha2(F.col("pack").cast("string"), 256))
    df = df.withColumn("hash", F.when(F.col("shard") == 2, F.lit("short")).otherwise(F.sha2(F.lit("x"), 256)))
    got = {(r.rule, r.shard) for r in packs.extent_violations(df).collect()}
    assert got == {("overlap", 3), ("bounds", 4), ("bounds", 5), ("bounds", 7), ("repeated shard", 6), ("hash", 2)}
    assert packs.single_extent(df, 1).first().length == 10
    for shard in (6, 9):
        with pytest.raises(CatalogError):
            packs.single_extent(df, shard)


def test_listing_keeps_its_limit(spark):
    from basalt.sources import store

    names = spark.range(5).select(F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(".pkg")).alias("name"))
    assert store.list_digests(names, most=5).count() == 5
    with pytest.raises(CatalogError, match="limit"):
        store.list_digests(names, most=4)


def test_reconcile_enforces_limits(spark):
    from basalt.plans.limits import V1
    from basalt.plans.reconcile import reconcile

    df = spark.createDataFrame([("snapshot", "i", sj.canonical(SNAPSHOT))], "kind string, identity string, body string")
    edges = spark.createDataFrame([], "child string, parent string")
    nodes = spark.range(17).select(F.col("id").cast("string").alias("node"))
    assert reconcile(df, nodes.limit(16), edges, limits=V1).summary().first().whole
    for more in ({"n": nodes}, {"limits": V1 | {"result_bytes": 100}}):
        with pytest.raises(CatalogError, match="limit"):
            reconcile(df, more.get("n", nodes.limit(16)), edges, limits=more.get("limits", V1))


def test_packing_takes_more_tasks_for_more_shards(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 200).alias("g"), F.col("id").alias("shard"), (F.col("id") % 7 + 1).alias("n"))
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    want = rows(packs.greedy_pack(df, "g", "shard", "n", target=20))
    monkeypatch.setattr(packs, "TASK", 100)
    got = packs.greedy_pack(df, "g", "shard", "n", target=20)
    assert got.rdd.getNumPartitions() == 30 and rows(got) == want and len(want) == 3000
