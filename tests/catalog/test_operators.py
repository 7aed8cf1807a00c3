import hashlib
import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import graph, layout, merge, packs, shards, validate
from basalt.plans.durable import scratch
from basalt.plans.reconcile import reconcile
from basalt.sources import store
from basalt.streaming.journal import journal_stream


def routed(n, size=lambda i: 100):
    return [(hashlib.sha256(str(i).encode()).hexdigest(), size(i)) for i in range(n)]


def leaves_by_search(rows, most, target):
    out, todo = {}, [""]
    while todo:
        p = todo.pop()
        own = [b for r, b in rows if r.startswith(p)]
        if len(own) <= 1 or (len(own) <= most and 84 + len(p) + sum(own) + len(own) <= target):
            out[p] = (len(own), sum(own))
        else:
            todo += [p + c for c in shards.HEX]
    return out


@pytest.mark.parametrize("n,most,target", [(0, 5, 500), (1, 1, 10), (5, 5, 10_000), (11, 3, 10_000), (700, 4, 10**6), (300, 1000, 700)])
@pytest.mark.parametrize("step", (1, 3))
def test_leaves_equal_search(spark, n, most, target, step):
    rows = routed(n, lambda i: 100 + i % 7)
    df = spark.createDataFrame(rows, "route string, bytes int")
    got = shards.adaptive_leaves(df, most, target, step)
    found = {r.prefix: (r.n, r.bytes) for r in got.collect()}
    assert found == leaves_by_search(rows, most, target)
    assert shards.cover_violations(got).count() == 0
    assert shards.assign_leaves(df, got).count() == n


def test_unsplittable_routes_fail(spark):
    df = spark.createDataFrame([("a" * 64, 1)] * 3, "route string, bytes int")
    with pytest.raises(validate.CatalogError):
        shards.adaptive_leaves(df, 2, 100, step=16)


@pytest.mark.parametrize("prefixes,rules", [([""], []), (["0"], ["last"]), ([c for c in "0123456789abcdef"], []), ([c for c in "0123456789abcdef"] + ["3"], ["overlap"]), (["", "a"], ["overlap"]), ([c for c in "123456789abcdef"], ["first"]), ([c for c in "012456789abcdef"], ["gap"])])
def test_cover(spark, prefixes, rules):
    found = shards.cover_violations(spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()
    assert sorted({r.rule for r in found}) == sorted(rules)


def test_graph_equals_search(spark):
    rng = random.Random(4)
    edges = sorted({(i, rng.randrange(i)) for i in range(1, 60) for _ in range(2)})
    nodes = [i for i in range(60) if i % 11]
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    def ancestors(i):
        seen, todo = set(), [i]
        while todo:
            todo += [p for p in up.get(todo.pop(), ()) if p not in seen and not seen.add(p)]
        return seen
    e, n = spark.createDataFrame(edges, "child int, parent int"), spark.createDataFrame([(i,) for i in nodes], "node int")
    closure = graph.ancestor_closure(e)
    assert {(r.node, r.ancestor) for r in closure.collect()} == {(i, a) for i in range(60) for a in ancestors(i)}
    assert {r.node for r in graph.heads(n, e).collect()} == set(nodes) - {p for _, p in edges}
    assert {r.node for r in graph.missing_parents(n, e).collect()} == {p for _, p in edges} - set(nodes)
    gaps = {i for i in range(60) if ancestors(i) - set(nodes)}
    assert {r.node for r in graph.incomplete(closure, n).collect()} == gaps
    assert graph.cycle_nodes(e).count() == 0
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (1, 5), (6, 6)], "child int, parent int")
    assert {r.node for r in graph.cycle_nodes(loop).collect()} == {1, 2, 3, 6}


def heads_case(spark, edges, ids):
    live = spark.createDataFrame([("a", "x", "live")], "head string, identity string, body string")
    dead = spark.createDataFrame([("b", "x", "dead")], "head string, identity string, body string")
    records = spark.createDataFrame([("snapshot", "y", "1")], "kind string, identity string, body string")
    return reconcile(records, spark.createDataFrame([(i,) for i in ids], "node string"), spark.createDataFrame(edges, "child string, parent string"), live, dead)


def test_tombstones_need_known_and_unrelated_heads(spark):
    assert [tuple(r) for r in heads_case(spark, [], "ab").conflicts.collect()] == [("tombstone-live", "x", 2)]
    r = heads_case(spark, [("a", "m"), ("b", "m")], "ab")
    assert r.conflicts.count() == 0 and r.missing_parents.count() == 1 and r.heads.count() == 2
    assert heads_case(spark, [("b", "a")], "ab").conflicts.count() == 0
    with pytest.raises(validate.CatalogError):
        heads_case(spark, [("a", "b"), ("b", "a")], "ab")


def test_merge_doesn_t_depend_on_order_and_keeps_claims(spark):
    rows = [("snapshot", "i", "b"), ("snapshot", "i", "a"), ("snapshot", "j", "c"), ("snapshot", "j", "c"), ("observation", "i", "z")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "kind string, identity string, body string").repartition(3)
        assert [tuple(r) for r in merge.identity_conflicts(df).collect()] == [("snapshot-claim", "i", 2, ["a", "b"])]
        assert {tuple(r) for r in merge.merged_union(df).collect()} == {("snapshot", "j", "c"), ("observation", "i", "z")}
    assert merge.result_budget(df).first().bytes == 5 * 65


def test_one_update_rewrites_one_bucket(spark):
    records = layout.synthetic_records(spark, 500, "s")
    sizes = records.agg(F.min(F.octet_length("payload")), F.max(F.octet_length("payload"))).first()
    assert 128 <= sizes[0] and sizes[1] <= 256
    a, b = scratch(spark, "a"), scratch(spark, "b")
    layout.write_sharded(records, a)
    updated = layout.apply_update(records, "rec-00000007", F.lit("new"))
    state = layout.write_sharded(updated, b, a).groupBy("state").count().collect()
    assert {r.state: r["count"] for r in state} == {"changed": 1, "reused": 63}
    back = layout.read_sharded(spark, b)
    assert layout.differences(back.select("id", "payload"), updated).count() == 0
    assert layout.misplaced(back).count() == 0
    table = spark.read.parquet(f"{a}/data")
    look = layout.pruned_lookup(table, "rec-00000007")
    assert look.count() == 1 and "PartitionFilters: [isnotnull(bucket" in look._jdf.queryExecution().toString()


def test_packs_round_trip_and_hostile_extents(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(1, 60)) for g in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "group int, shard int, length int")
    got = {(r.group, r.shard): (r.pack, r.offset) for r in packs.greedy_pack(df, "group", "shard", "length", 100).collect()}
    for g in range(3):
        pack = used = 0
        for _, i, n in sorted(r for r in rows if r[0] == g):
            if used and used + n > 100:
                pack, used = pack + 1, 0
            assert got[g, i] == (pack, used)
            used += n
    data = spark.createDataFrame([(1, 0, b"abcdef")], "group int, pack int, data binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    extents = [(1, 0, 1, 0, 3, sha(b"abc")), (1, 0, 2, 2, 3, sha(b"cde")), (1, 0, 3, 4, 9, "x"), (1, 0, 4, -1, 2, "x"), (1, 1, 5, 0, 1, "x")]
    ex = spark.createDataFrame(extents, "group int, pack int, shard int, offset int, length int, hash string")
    assert {r.shard: r.ok for r in packs.unpack(ex, data).collect()} == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert {r.shard for r in packs.extent_overlaps(ex, ["group", "pack"]).collect()} == {1, 2, 3}


def test_journal(spark):
    path = scratch(spark, "journal") + "/objects"
    objects = spark.createDataFrame([(hashlib.sha256(d).hexdigest(), d) for d in (b"a", b"b", b"b")], "sha256 string, data binary")
    assert store.put(spark, path, objects) == 2 and store.put(spark, path, objects) == 0
    assert store.get(spark, path, hashlib.sha256(b"a").hexdigest()) == b"a"
    with pytest.raises(validate.CatalogError):
        store.get(spark, path, "0" * 64)
    with pytest.raises(validate.CatalogError):
        store.put(spark, path, spark.createDataFrame([("0" * 64, b"x")], "sha256 string, data binary"))
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    fine = "a" * 64 + ".pkg"
    assert [r.sha256 for r in store.list_digests(names(fine, ".tmp-01")).collect()] == ["a" * 64]
    for bad in (names(fine, "x"), names("../" + fine)):
        with pytest.raises(validate.CatalogError):
            store.list_digests(bad)
    with pytest.raises(validate.CatalogError):
        store.list_digests(names(fine, ".tmp-01"), most=1)


def test_journal_stream_writes_once(spark, tmp_path):
    source, path = str(tmp_path / "in"), scratch(spark, "journal") + "/objects"
    rows = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "data binary")
    rows.write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("data binary").parquet(source)
        journal_stream(stream, path, str(tmp_path / f"check{_}")).awaitTermination()
    assert store.read(spark, path).count() == 2


def test_validators(spark):
    df = spark.createDataFrame([(1, "c1", "ok"), (2, "c2", "bad"), (3, "c9", "ok"), (4, None, "ok")], "i int, codec string, content string")
    policies = {"c1": lambda c: F.when(c != "ok", "content"), "c2": lambda c: F.when(c != "ok", "content")}
    found = validate.codec_violations(df, F.col("i"), F.col("codec"), F.col("content"), policies).collect()
    assert {(r.identity, r.rule) for r in found} == {(2, "content"), (3, "unknown codec"), (4, "unknown codec")}
    with pytest.raises(validate.CatalogError):
        validate.at_most(df, 3)
    assert validate.at_most(df, 4).count() == 4
    known, required = (spark.createDataFrame([(e,) for e in es], "epoch string") for es in ("ab", "abc"))
    assert validate.covers_epochs(required, known, "epoch") and not validate.covers_epochs(known, required, "epoch")
    many = spark.createDataFrame([(e,) for e in "abcd"], "epoch string")
    assert not validate.covers_epochs(many, known, "epoch")


def test_expected_bindings(spark):
    from basalt.operators.validate import binding_mismatches

    meta = "metadata struct<network:struct<id:string,genesisHash:string>,contract:struct<address:string>,states:array<string>>"
    had = [(1, (("n", None), ("a",), ["x", None])), (2, (None, ("a",), None)), (3, None), (4, (("n", "g"), None, []))]
    want = [(i, (("n", None), ["x", None])) for i in (1, 2, 3, 4, 5)]
    opened = spark.createDataFrame(had, f"id int, {meta}")
    found = lambda rows, kind: sorted((r.id, r.path) for r in binding_mismatches(opened, spark.createDataFrame(rows, kind), "id").collect())
    got = found(want, "id int, metadata struct<network:struct<id:string,genesisHash:string>,states:array<string>>")
    assert got == [(2, "metadata.network"), (2, "metadata.states"), (3, "metadata"), (4, "metadata.network.genesisHash"), (4, "metadata.states"), (5, "metadata")]
    assert found([(i, ((),)) for i in (1, 3)], "id int, metadata struct<network:struct<>>") == [(3, "metadata")]
    assert found([(3, None), (1, None)], "id int, metadata struct<network:struct<id:string>>") == [(1, "metadata")]
    assert found([(1, ("x",)), (4, (None,))], "id int, metadata struct<zone:string>") == [(1, "metadata.zone"), (4, "metadata.zone")]


def test_concurrent_generations_all_stay(spark):
    from basalt.operators import graph

    rows = [("r", "a", 1), ("r", "b", 2), ("r", "c", 1), ("s", "a", 1), ("t", None, 1)]
    snaps = spark.createDataFrame(rows, "record string, generation string, epoch int")
    closure = graph.ancestor_closure(spark.createDataFrame([("b", "a"), ("c", "a"), ("d", "b")], "child string, parent string"))
    got = lambda where=None: sorted((r.record, r.generation or "") for r in graph.maximal_generations(snaps, closure, "record", "generation", where).collect())
    assert got() == [("r", "b"), ("r", "c"), ("s", "a"), ("t", "")]
    assert got(F.col("epoch") == 1) == [("r", "c"), ("s", "a"), ("t", "")]


def test_only_outcomes_that_break_a_rule_move(spark):
    seen = [(1, "a", "unavailable", "x", 1), (1, "b", "readback-authenticated", "f" * 64, 1), (1, "c", "readback-authenticated", "A", 1), (1, "d", "digest-mismatch", "f" * 64, 9), (1, "e", "readback-authenticated", "f" * 64 + "\n", 1), (1, "f", "readback-authenticated", "f" * 64, 2), (1, "g", None, "x", 1)]
    obs = spark.createDataFrame(seen, "k int, identity string, status string, observed string, length int")
    snaps = spark.createDataFrame([(1, "f" * 64, 1)], "k int, digest string, bytes int")
    found = validate.outcome_violations(obs, snaps, "k")
    assert {tuple(r) for r in found.collect()} == {("c", "digest"), ("d", "same digest"), ("e", "digest"), ("f", "length")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "status" not in plan.split("Join")[0] and "unhex" in plan


def test_leaves_come_from_few_counts(spark, monkeypatch):
    """Records that one more digit parts well enough aren't counted under three more, or there are as many counts as records."""
    kept, checkpoint = [], shards.checkpoint

    def counted(df):
        kept.append(checkpoint(df))
        return kept[-1]

    monkeypatch.setattr(shards, "checkpoint", counted)
    rows = [("abc" + hashlib.sha256(str(i).encode()).hexdigest()[3:], 10) for i in range(3000)]
    got = shards.adaptive_leaves(spark.createDataFrame(rows, "route string, bytes int"), 300, 10**6)
    assert {r.prefix: (r.n, r.bytes) for r in got.collect()} == leaves_by_search(rows, 300, 10**6)
    assert max(df.count() for df in kept) <= 100
