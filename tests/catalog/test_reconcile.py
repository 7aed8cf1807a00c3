import json

import pytest
from test_planner import id32, sha
from test_records import META, PACKAGE, PLACE, RECEIPT, SEEN, SNAPSHOT, TOMBSTONE

from basalt.functions import strict_json as sj
from basalt.operators.validate import CatalogError
from basalt.plans.limits import V1
from basalt.plans.reconcile import reconcile_catalogs

A, B, C, GONE = (c * 64 for c in "abc9")


def place(i):
    return PLACE | {"objectId": f"o{i}"}


def snapshot(i, *places, **change):
    return SNAPSHOT | {"package": PACKAGE | {"sha256": sha(i)}, "locators": [place(p) for p in places or (0,)]} | change


def seen(i, of, at=0, **change):
    return SEEN | {"observationId": id32(("o", i)), "packageSha256": sha(of), "locator": place(at)} | change


def dead(i, of, **change):
    return TOMBSTONE | {"eventId": id32(("t", i)), "targetPackageSha256": sha(of)} | change


def catalog(entries=(), observations=(), parents=()):
    return {"payloadVersion": 1, "parents": list(parents), "entries": list(entries), "observations": list(observations)}


def reconciled(spark, revisions, limits=V1):
    rows = [(k, c if isinstance(c, bytes) else json.dumps(c).encode()) for k, c in revisions]
    return reconcile_catalogs(spark.createDataFrame(rows, "revision string, data binary"), limits)


def text(result):
    rows = result.catalog().collect()
    return json.loads(bytes(rows[0].data)) if rows else None


def names(df):
    return sorted(r.node for r in df.collect())


def size(*values):
    return sum(len(sj.canonical(v).encode()) + 64 for v in values)


def merged(*entries):
    return sorted(entries, key=lambda e: (e["entryKind"], e.get("eventId") or e.get("receiptId") or e["package"]["sha256"]))


def test_union_of_forks_in_every_order(spark):
    base = catalog([snapshot(1, 1)], [seen(1, 1, 1)])
    left = catalog([snapshot(1, 2), snapshot(2)], [seen(2, 2)], [A])
    right = catalog([snapshot(1, 3, 1), dead(1, 1), RECEIPT], [seen(3, 1, 3)], [A, GONE])
    united = merged(snapshot(1, 1, 2, 3), snapshot(2), dead(1, 1), RECEIPT)
    want = catalog(united, sorted([seen(1, 1, 1), seen(2, 2), seen(3, 1, 3)], key=lambda o: o["observationId"]), [B, C])
    snapshot_at_right = snapshot(1, 1, 3)
    used = size(A, 1, snapshot(1, 1), seen(1, 1, 1)) + size(B, 1, A, snapshot(1, 2), snapshot(2), seen(2, 2)) + size(C, 1, A, GONE, snapshot_at_right, dead(1, 1), RECEIPT, seen(3, 1, 3))
    used += size(B, C, GONE, "unknown") + size(1, B, C, *united, *want["observations"])
    for order in ([(A, base), (B, left), (C, right)], [(C, right), (B, left), (A, base)]):
        got = reconciled(spark, order)
        assert text(got) == want and got.conflicts.count() == 0 and got.whole
        assert names(got.heads) == [B, C] and names(got.missing_parents) == [GONE] and names(got.nodes) == [A, B, C] and got.bytes == used


def clash(spark, *revisions):
    got = reconciled(spark, revisions)
    assert text(got) is None
    return sorted((r.conflict, r.identity, [json.loads(c) for c in r.claims]) for r in got.conflicts.collect())


def test_conflicts_keep_every_claim(spark):
    one, other = snapshot(1, 1), snapshot(1, 2, label="other")
    order = lambda *claims: sorted(claims, key=sj.canonical)
    assert clash(spark, (A, catalog([one, snapshot(2)])), (B, catalog([other]))) == [("snapshot-claim", sha(1), order(one, other))]
    receipt = RECEIPT | {"rootRevisionId": id32("x")}
    late = seen(1, 1, 1, observedAt="2027-01-01T00:00:00Z")
    got = clash(spark, (A, catalog([one, dead(1, 9), RECEIPT], [seen(1, 1, 1)])), (B, catalog([one, dead(1, 9, reason="user-request"), receipt], [late])))
    assert got == sorted(
        [("event-claim", id32(("t", 1)), order(dead(1, 9), dead(1, 9, reason="user-request"))), ("observation-claim", id32(("o", 1)), order(seen(1, 1, 1), late)), ("receipt-claim", RECEIPT["receiptId"], order(RECEIPT, receipt))],
        key=lambda x: x[:2],
    )
    # alive at one head and dead at another, both ancestries known
    assert clash(spark, (A, catalog([one])), (B, catalog([dead(1, 1)]))) == [("tombstone-live", sha(1), order(one, dead(1, 1)))]


def test_causality(spark):
    one = snapshot(1, 1)
    got = reconciled(spark, [(A, catalog([one, dead(1, 1)], parents=[GONE]))])
    assert text(got)["entries"] == merged(one, dead(1, 1)) and names(got.missing_parents) == [GONE]
    got = reconciled(spark, [(A, catalog([one])), (B, catalog([one, dead(1, 1)], parents=[A]))])
    assert text(got)["entries"] == merged(one, dead(1, 1)) and names(got.heads) == [B]
    got = reconciled(spark, [(A, catalog([one], parents=[GONE])), (B, catalog([dead(1, 1)], parents=[GONE]))])
    assert text(got)["entries"] == merged(one, dead(1, 1)) and names(got.heads) == [A, B]


def refused(spark, code, *revisions, **limits):
    with pytest.raises(CatalogError) as e:
        reconciled(spark, revisions, V1 | limits)
    assert e.value.code == code, e.value


def test_errors_have_their_class(spark):
    one = catalog([snapshot(1, 1)])
    spaced = json.dumps(one, indent=1).encode()
    assert names(reconciled(spark, [(A, one), (A, spaced)]).nodes) == [A]
    refused(spark, "conflict", (A, one), (A, catalog([snapshot(2)])))
    refused(spark, "conflict", (A, catalog([snapshot(1, 1), snapshot(1, 1, label="other")])))
    refused(spark, "input", (A, catalog(parents=[B])), (B, catalog(parents=[A])))
    refused(spark, "input", (A, catalog(parents=[A])))
    refused(spark, "input", (A, catalog([snapshot(1, metadata=META | {"retentionClass": "x"})])))
    refused(spark, "input", ("A" * 64, one))
    refused(spark, "limit", *[(sha(i), one) for i in range(17)])
    refused(spark, "limit")
    refused(spark, "limit", (A, catalog([snapshot(1, *range(16))])), (B, catalog([snapshot(1, 16)])))
    refused(spark, "limit", (A, catalog([snapshot(i) for i in range(5)])), (B, catalog([snapshot(i, label="other") for i in range(5)])), entries=9)
    refused(spark, "limit", (A, one), result_bytes=1500)
    refused(spark, "reference", (A, catalog([snapshot(1, 1)], [seen(1, 1, 2)])))
    refused(spark, "reference", (A, catalog([snapshot(1, 1)], [seen(1, 2, 1)])))


def test_what_is_reconciled_is_shuffled_once(spark):
    """Union and conflicts are read from what was written, and claims move by identity once."""
    got = reconciled(spark, [(A, catalog([dead(1, 1), dead(2, 2)])), (B, catalog([dead(1, 1), dead(2, 2, reason="user-request")], parents=[A]))])
    for table in (got.union, got.conflicts):
        assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    assert [(r.kind, r.identity) for r in got.union.collect()] == [("tombstone", id32(("t", 1)))]
    assert [(r.conflict, r.identity, len(r.claims)) for r in got.conflicts.collect()] == [("event-claim", id32(("t", 2)), 2)]


def test_records_that_come_twice_in_one_catalog(spark):
    """Equal ones count once and places are united, in the catalogs that have them; others are beside them as they were."""
    twice = catalog([snapshot(1, 2), snapshot(1, 1), dead(1, 9), dead(1, 9)], [seen(1, 1, 1), seen(2, 1, 2)])
    once = catalog([snapshot(2, 3, 1)])
    got = reconciled(spark, [(A, twice), (A, json.dumps(twice, indent=1).encode()), (B, once)])
    assert text(got)["entries"] == merged(snapshot(1, 1, 2), snapshot(2, 1, 3), dead(1, 9))
    used = size(A, 1, snapshot(1, 1, 2), dead(1, 9), seen(1, 1, 1), seen(2, 1, 2)) + size(B, 1, snapshot(2, 3, 1))
    assert got.bytes == used + size(A, B, "unknown") + size(1, A, B, snapshot(1, 1, 2), snapshot(2, 1, 3), dead(1, 9), seen(1, 1, 1), seen(2, 1, 2))
    refused(spark, "conflict", (A, catalog([dead(1, 9), dead(1, 9, reason="user-request")])), (B, once))
    # places of a claim are in order whether it is alone in its catalog or not
    assert clash(spark, (A, catalog([snapshot(1, 3, 1), snapshot(2)])), (B, catalog([dead(1, 1)]))) == [("tombstone-live", sha(1), sorted([snapshot(1, 1, 3), dead(1, 1)], key=sj.canonical))]
