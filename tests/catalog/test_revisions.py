import hashlib
import json

from test_planner import identity, observation, sha, snapshot, tombstone
from test_records import EPOCH, ID, PLACE2

from basalt.functions import strict_json as sj
from basalt.plans.revision import validate_revisions


def route(r):
    return sha(json.dumps(["WPP/catalog-route/v2", r["recordKind"], identity(r)], separators=(",", ":")))


def revision(records, **change):
    """Root and shards of a revision cut by the first digit; shards may be changed before the root is made."""
    shards = {}
    for r in sorted(records, key=lambda r: (route(r), r["recordKind"], identity(r))):
        shards.setdefault(route(r)[0], []).append(r)
    nodes = {d: {"payloadVersion": 2, "nodeType": "shard", "partitionVersion": 1, "prefix": d, "records": own} for d, own in shards.items()}
    references = []
    for d in "0123456789abcdef":
        if d not in nodes:
            references.append({"prefix": d, "empty": True})
            continue
        own, text = nodes[d]["records"], sj.canonical(nodes[d])
        entries = sum(r["recordKind"] != "observation" for r in own)
        references.append(
            {
                "prefix": d, "empty": False, "recordId": ID, "generationId": ID, "rootEpoch": EPOCH, "wireSha256": "a" * 64, "wireByteLength": 300, "plaintextByteLength": len(text.encode()),
                "entryCount": entries, "observationCount": len(own) - entries, "canonicalRecordsSha256": hashlib.sha256(sj.canonical(own).encode()).hexdigest(), "locators": [PLACE2],
            }
        )
    entries = sum(r["recordKind"] != "observation" for r in records)
    root = {"payloadVersion": 2, "nodeType": "root", "partitionVersion": 1, "parents": [], "entryCount": entries, "observationCount": len(records) - entries, "requiredEpochs": [EPOCH], "references": references}
    return root | change, [nodes[d] for d in sorted(nodes)]


RECORDS = [snapshot(i) for i in range(25)] + [observation(i, i % 25) for i in range(40)] + [tombstone(i, i) for i in (3, 4)]


def test_every_rule_of_a_revision(spark):
    root, nodes = revision(RECORDS)
    big = max(range(len(nodes)), key=lambda i: len(nodes[i]["records"]))

    def swapped(i, **change):
        return [*nodes[:i], nodes[i] | change, *nodes[i + 1 :]]

    def with_reference(prefix, **change):
        return root | {"references": [r | change if r["prefix"] == prefix else r for r in root["references"]]}

    held = nodes[big]["records"]
    at = nodes[big]["prefix"]
    swap_text = sj.canonical(held[::-1])
    other, third = "B" * 21 + "A", "C" * 21 + "A"
    size = next(r for r in root["references"] if r["prefix"] == at)["plaintextByteLength"]
    cases = {
        "fine": ((root, nodes), set()),
        "nothing": (revision([]), set()),
        "order": ((with_reference(at, canonicalRecordsSha256=hashlib.sha256(swap_text.encode()).hexdigest()), swapped(big, records=held[::-1])), {"order in a shard"}),
        "digest": ((with_reference(at, canonicalRecordsSha256="b" * 64), nodes), {"manifest: fingerprint"}),
        "bytes": ((with_reference(at, plaintextByteLength=size + 1), nodes), {"manifest: bytes", "bytes of shards"}),
        "fewer bytes": ((with_reference(at, plaintextByteLength=size - 1), nodes), {"manifest: bytes", "bytes of shards", "over budget"}),
        "shard gone": ((root, nodes[:-1]), None),
        "shard twice": ((root, [*nodes, nodes[0]]), {"repeated shard", "number of shards", "bytes of shards", "over budget", "repeated identity", "entries of records", "observations of records"}),
        "prefix": ((root, swapped(big, prefix="g")), None),
        "elsewhere": ((root, swapped(0, prefix=nodes[1]["prefix"])), None),
        "entries": ((root | {"entryCount": root["entryCount"] + 1}, nodes), {"entries", "entries of records"}),
        "epoch": ((root | {"requiredEpochs": [EPOCH, other]}, nodes), set()),
        "epochs": ((root | {"requiredEpochs": [EPOCH, other, third]}, nodes), {"epochs beyond one"}),
        "no epoch": ((root | {"requiredEpochs": [other]}, nodes), {"epoch", "reference epoch"}),
        "dangling": (revision(RECORDS + [observation(99, 99)]), {"dangling observation"}),
        "place": (revision(RECORDS + [observation(99, 1, locator=PLACE2 | {"objectId": "there"})]), {"unlisted locator"}),
        "outcome": (revision(RECORDS + [observation(99, 1, outcome={"status": "digest-mismatch", "observedSha256": sha(1)})]), {"outcome: same digest"}),
        "twice": (revision(RECORDS + [snapshot(1, label="other")]), None),
        "record": (revision(RECORDS + [snapshot(77, label="\n")]), {"record: label"}),
    }
    roots = spark.createDataFrame([(k, sj.canonical(r).encode()) for k, ((r, _), _) in cases.items()], "revision string, data binary").repartition(3)
    rows = [(k, i, sj.canonical(n).encode()) for k, ((_, own), _) in cases.items() for i, n in enumerate(own)] + [("orphan", 0, sj.canonical(nodes[0]).encode())]
    got = validate_revisions(roots, spark.createDataFrame(rows, "revision string, position int, data binary").repartition(3))
    found = {k: set() for k in [*cases, "orphan"]}
    for r in got.violations.collect():
        found[r.identity].add(r.rule)
    for k, (_, want) in cases.items():
        assert found[k] == want if want is not None else found[k], (k, found[k])
    assert "no root" in found["orphan"] and "misplaced record" in found["prefix"] and "misplaced record" in found["elsewhere"]
    assert {"number of shards", "manifest: missing"} <= found["shard gone"] and {"repeated identity", "order in a shard"} <= found["twice"]
    live = {r.digest for r in got.live.where("revision = 'fine'").collect()}
    assert live == {sha(i) for i in range(25) if i not in (3, 4)}
    row = got.totals.where("revision = 'fine'").first()
    assert (row.entries, row.observations, row.epochs, row.live, row.live_bytes) == (27, 40, 1, 23, 69)
    last = {r.revision: (r.position, r.length, r.used) for r in got.first_over.collect()}
    sizes = [len(sj.canonical(n).encode()) for n in nodes]
    assert last["shard twice"] == (len(nodes), sizes[0], sum(sizes) + sizes[0]) and "fine" not in last
