import hashlib
import json

from pyspark.sql import functions as F

from basalt.functions import scalars as fn, strict_json as sj
from basalt.operators import shards
from basalt.plans.revision import revision_violations
from basalt.sources import ingest

SHA = hashlib.sha256(b"package").hexdigest()
LOCATOR = {"provider": "drive", "accountBinding": {"scheme": "s", "value": "v"}, "objectId": "o", "revisionId": None}
ENTRY = {"entryKind": "snapshot", "package": {"sha256": SHA, "byteLength": 3, "rootEpoch": "e", "scopeId": "s", "recordId": "r", "generationId": "g"}, "metadata": None, "label": "", "locators": [LOCATOR]}
SEEN = {"observationId": "o1", "packageSha256": SHA, "locator": LOCATOR, "observedAt": "2026-01-01T00:00:00Z", "outcome": {"status": "not-found"}}


def catalog(**change):
    return json.dumps({"payloadVersion": 1, "parents": ["a" * 64], "entries": [ENTRY], "observations": [SEEN]} | change).encode()


def test_catalogs(spark):
    from test_records import META, PACKAGE, PLACE, SEEN as OTHER

    LOCATOR, SHA = PLACE, PACKAGE["sha256"]
    ENTRY = {"entryKind": "snapshot", "package": PACKAGE, "metadata": META, "label": None, "locators": [PLACE]}
    SEEN = OTHER
    catalog = lambda **change: json.dumps({"payloadVersion": 1, "parents": ["a" * 64], "entries": [ENTRY], "observations": [SEEN]} | change).encode()
    texts = {
        "nested": catalog(entries=[ENTRY | {"package": PACKAGE | {"more": 1}}]), "malformed": catalog(entries=[ENTRY | {"package": PACKAGE | {"rootEpoch": "e"}}]), "unknown": catalog(entries=[ENTRY | {"entryKind": "letter"}]),
        "mistyped": catalog(entries=[ENTRY | {"label": 5}]), "repeated": catalog(entries=[ENTRY | {"locators": [PLACE, PLACE]}]), "bare": catalog(entries=[ENTRY | {"metadata": META | {"codec": None}}]),
        "fine": catalog(), "extra": catalog(more=1), "version": catalog(payloadVersion=2), "parents": catalog(parents=["a" * 64] * 2), "twice": catalog(observations=[SEEN, SEEN]),
        "locators": catalog(entries=[ENTRY | {"locators": [LOCATOR | {"objectId": str(i)} for i in range(17)]}]), "broken": b'{"a":1,"a":1}', "none": b"",
    }
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "revision string, data binary")
    got = ingest.parse_catalogs(df)
    found = {(r.identity, r.rule) for r in got.violations.collect()}
    assert found == {("extra", "fields"), ("version", "version"), ("parents", "parents"), ("twice", "observation repeats"), ("locators", "locators"), ("locators", "record: locators"), ("nested", "record: closed"), ("malformed", "record: root epoch"), ("unknown", "record: kind"), ("mistyped", "record: closed"), ("repeated", "record: locators"), ("bare", "record: codec"), ("broken", "json: duplicate-key"), ("none", "json: empty")}
    one = got.entries.where("revision = 'fine'").collect()
    assert [(r.kind, r.identity) for r in one] == [("snapshot", SHA)] and one[0].body == sj.canonical(ENTRY)
    assert [r.identity for r in got.observations.where("revision = 'fine'").collect()] == [SEEN["observationId"]]
    assert got.parents.where("child = 'fine'").count() == 1


def test_nodes(spark):
    root = {"payloadVersion": 2, "nodeType": "root", "partitionVersion": 1, "parents": [], "entryCount": 0, "observationCount": 0, "requiredEpochs": [], "references": [{"prefix": "", "empty": True}]}
    texts = {"fine": sj.canonical(root), "spaced": json.dumps(root), "role": sj.canonical(root | {"nodeType": "shard"}), "count": sj.canonical(root | {"entryCount": 1})}
    refs, bad = ingest.parse_roots(spark.createDataFrame([(k, v.encode()) for k, v in texts.items()], "revision string, data binary"))
    assert {(r.identity, r.rule) for r in bad.collect()} == {("spaced", "canonical"), ("role", "role"), ("count", "entries")}
    assert [(r.prefix, r.empty) for r in refs.where("revision = 'fine'").collect()] == [("", True)]
    shard = {"payloadVersion": 2, "nodeType": "shard", "partitionVersion": 1, "prefix": "0", "records": [{"recordKind": "snapshot", "body": {"b": 1, "a": [None]}}]}
    rows, bad = ingest.parse_shards(spark.createDataFrame([("s", sj.canonical(shard).encode()), ("v1", catalog())], "revision string, data binary"))
    assert [(r.prefix, r.kind, r.body) for r in rows.where("revision = 's'").collect()] == [("0", "snapshot", '{"a":[null],"b":1}')]
    # the node is fine, its one record isn't a snapshot
    found = {r.rule for r in bad.where("identity = 's'").collect()}
    assert {"record: closed", "record: named kind"} <= found and all(rule.startswith("record: ") for rule in found)


def reference(prefix, entries=2, observations=1, **change):
    from test_records import EPOCH, ID, PLACE2

    return {
        "prefix": prefix, "empty": False, "recordId": ID, "generationId": ID, "rootEpoch": EPOCH, "wireSha256": "a" * 64, "wireByteLength": 300, "plaintextByteLength": 200,
        "entryCount": entries, "observationCount": observations, "canonicalRecordsSha256": "b" * 64, "locators": [PLACE2],
    } | change


def test_preflight_of_roots(spark):
    from test_records import EPOCH, PLACE

    without = lambda d, k: {a: b for a, b in d.items() if a != k}
    full = [reference(d) if d != "3" else {"prefix": "3", "empty": True} for d in "0123456789abcdef"]
    root = {"payloadVersion": 2, "nodeType": "root", "partitionVersion": 1, "parents": ["c" * 64], "entryCount": 30, "observationCount": 15, "requiredEpochs": [EPOCH], "references": full}
    swap = lambda at, ref: root | {"references": [*full[:at], ref, *full[at + 1 :]]}
    cases = {
        "fine": (root, set()), "whole": (root | {"references": [{"prefix": "", "empty": True}], "entryCount": 0, "observationCount": 0, "requiredEpochs": []}, set()),
        "gap": (root | {"references": [r for r in full if r["prefix"] != "3"]}, {"cover: gap"}), "first": (root | {"references": [r for r in full if r["prefix"] != "0"], "entryCount": 28, "observationCount": 14}, {"cover: first"}),
        "last": (root | {"references": full[:-1], "entryCount": 28, "observationCount": 14}, {"cover: last"}), "nested": (root | {"references": [*full[:5], {"prefix": "40", "empty": True}, *full[5:]]}, {"cover: overlap", "cover: gap"}),
        "order": (root | {"references": [full[1], full[0], *full[2:]]}, {"order"}), "twice": (root | {"references": [full[3], *full]}, {"order", "cover: overlap"}),
        "entries": (root | {"entryCount": 31}, {"entries"}), "observations": (root | {"observationCount": 0}, {"observations"}), "many": (root | {"entryCount": 10_001}, {"counts", "entries"}),
        "epoch": (root | {"requiredEpochs": []}, {"reference epoch"}), "epochs": (root | {"requiredEpochs": [EPOCH, EPOCH]}, {"epochs"}), "parents": (root | {"parents": ["d" * 64, "c" * 64]}, {"parents"}), "digest": (root | {"parents": ["C" * 64]}, {"parents"}),
        "budget": (swap(0, reference("0", plaintextByteLength=256 * 1024 + 1)), {"reference: budget"}), "one": (swap(0, reference("0", 2, 0, plaintextByteLength=256 * 1024)) | {"observationCount": 14}, set()),
        "single": (swap(0, reference("0", 1, 0, plaintextByteLength=1 << 20)) | {"entryCount": 29, "observationCount": 14}, set()), "single more": (swap(0, reference("0", 1, 0, plaintextByteLength=(1 << 20) + 1)) | {"entryCount": 29, "observationCount": 14}, {"reference: bytes", "reference: budget"}),
        "no records": (swap(0, reference("0", 0, 0)) | {"entryCount": 28, "observationCount": 14}, {"reference: records"}), "too many": (swap(0, reference("0", 1024, 1)) | {"entryCount": 1052}, {"reference: records"}),
        "absent": (swap(0, without(reference("0"), "wireSha256")), {"reference: closed", "reference: wire digest"}), "null": (swap(0, reference("0", recordId=None)), {"reference: ids"}), "more": (swap(0, reference("0", zone=None)), {"reference: closed"}),
        "blank": (swap(3, {"prefix": "3", "empty": True, "entryCount": 0}), {"reference: closed"}), "wide": (swap(0, reference("0", locators=[PLACE])), {"reference: locators"}), "no locators": (swap(0, reference("0", locators=[])), {"reference: locators"}),
        "upper": (swap(3, {"prefix": "3G", "empty": True}), {"reference: prefix", "cover: gap"}), "fields": (without(root, "parents"), {"fields", "parents"}),
    }
    got = ingest.preflight_roots(spark.createDataFrame([(k, sj.canonical(r).encode()) for k, (r, _) in cases.items()], "revision string, data binary").repartition(4))
    found = {k: set() for k in cases}
    for r in got.violations.collect():
        found[r.identity].add(r.rule)
    assert found == {k: rules for k, (_, rules) in cases.items()}
    totals = {r.revision: (r.entries, r.observations, r.bytes, r.shards) for r in got.totals.collect()}
    assert totals["fine"] == (30, 15, 3000, 15) and totals["whole"] == (0, 0, 0, 0) and totals["single"] == (29, 14, 2800 + (1 << 20), 15)


def test_records_of_shards(spark):
    from test_records import META, PACKAGE, PLACE2, RECEIPT, SEEN, SNAPSHOT2, TOMBSTONE

    other = SEEN | {"locator": PLACE2}
    kinds = {"snapshot": SNAPSHOT2, "tombstone": TOMBSTONE, "root-update-receipt": RECEIPT, "observation": other}
    tag = lambda kind, body, **more: {"recordKind": kind, "body": body} | more
    cases = {
        "fine": ([tag(k, b) for k, b in kinds.items()], set()),
        "wide": ([tag("snapshot", SNAPSHOT2 | {"locators": [PLACE2 | {"objectId": "o" * 129}]})], {"record: locators"}),
        "five": ([tag("snapshot", SNAPSHOT2 | {"locators": [PLACE2 | {"objectId": str(i)} for i in range(5)]})], {"record: locators"}),
        "bound": ([tag("observation", other | {"locator": PLACE2 | {"accountBinding": {"scheme": "s", "value": "v"}}})], {"record: locator"}),
        "more": ([tag("tombstone", TOMBSTONE, zone=1)], {"record: fields"}), "nobody": ([{"recordKind": "tombstone"}], None), "kind": ([tag("letter", {})], {"record: kind", "record: named kind"}),
        "other kind": ([tag("tombstone", RECEIPT)], None), "said": ([tag("observation", other | {"entryKind": "snapshot"})], {"record: closed", "record: named kind"}),
        "kept": ([tag("snapshot", SNAPSHOT2 | {"metadata": META | {"retentionClass": "x"}})], {"record: metadata"}), "package": ([tag("snapshot", SNAPSHOT2 | {"package": PACKAGE | {"byteLength": 0}})], {"record: package bytes"}),
    }
    node = {"payloadVersion": 2, "nodeType": "shard", "partitionVersion": 1, "prefix": "0"}
    rows, bad = ingest.parse_shards(spark.createDataFrame([(k, sj.canonical(node | {"records": r}).encode()) for k, (r, _) in cases.items()], "revision string, data binary"))
    found = {k: set() for k in cases}
    for r in bad.collect():
        found[r.identity].add(r.rule)
    assert all(found[k] == want if want is not None else found[k] for k, (_, want) in cases.items()), found
    assert {r.kind: r.body for r in rows.where("revision = 'fine'").collect()} == {k: sj.canonical(b) for k, b in kinds.items()}


def test_whole_revision(spark):
    rows = [("snapshot", str(i), f'{{"i":{i}}}', None) for i in range(400)] + [("observation", f"o{i}", "{}", str(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "kind string, identity string, body string, package string").withColumn("route", fn.route_hash(F.col("kind"), F.col("identity")))
    records = df.withColumn("prefix", F.substring("route", 1, 1))
    refs = shards.shard_summary(records)
    digits = spark.createDataFrame([(c,) for c in "0123456789abcdef"], "prefix string")
    assert digits.join(refs, "prefix", "left_anti").count() == 0
    known = spark.createDataFrame([("a",), ("b",)], "epoch string")
    assert revision_violations(refs, records, known, known).count() == 0
    bad = records.where("identity <> '3'").union(records.where("identity = '4'")).withColumn("prefix", F.when(F.col("identity") == "5", "g").otherwise(F.col("prefix")))
    found = {(r.rule, r.identity) for r in revision_violations(refs, bad, known.where("epoch = 'a'"), known).collect()}
    assert {("misplaced", "5"), ("repeated identity", "4"), ("dangling observation", "o3"), ("epoch", "b"), ("manifest: extra", "g")} <= found


def test_observations_of_a_revision(spark):
    other = "b" * 64
    claims = {
        "fine": {}, "read": {"outcome": {"status": "readback-authenticated", "observedSha256": SHA, "byteLength": 3}}, "differs": {"outcome": {"status": "digest-mismatch", "observedSha256": other}},
        "place": {"locator": LOCATOR | {"objectId": "p"}}, "digest": {"outcome": {"status": "readback-authenticated", "observedSha256": other, "byteLength": 3}},
        "length": {"outcome": {"status": "readback-authenticated", "observedSha256": SHA, "byteLength": 4}}, "bare": {"outcome": {"status": "readback-authenticated"}},
        "same": {"outcome": {"status": "digest-mismatch", "observedSha256": SHA}},
    }
    rows = [("snapshot", SHA, sj.canonical(ENTRY), None)] + [("observation", k, sj.canonical(SEEN | {"observationId": k} | c), SHA) for k, c in claims.items()]
    df = spark.createDataFrame(rows, "kind string, identity string, body string, package string").withColumn("route", fn.route_hash(F.col("kind"), F.col("identity")))
    records = df.withColumn("prefix", F.lit(""))
    epochs = spark.createDataFrame([("e",)], "epoch string")
    found = revision_violations(shards.shard_summary(records), records, epochs, epochs).collect()
    assert {(r.rule, r.identity) for r in found} == {("unlisted locator", "place"), ("outcome: digest", "digest"), ("outcome: digest", "bare"), ("outcome: length", "length"), ("outcome: same digest", "same")}


def test_a_record_does_not_carry_its_catalog(spark):
    """Or the rows of a catalog would take the square of its records, queued on disk before Python."""
    import re

    got = ingest.parse_catalogs(spark.createDataFrame([("r", catalog())], "revision string, data binary"))
    for table in (got.entries, got.observations):
        plan = table._jdf.queryExecution().executedPlan().toString()
        carried = re.findall(r"Generate .*\), \[(.*?)\], (?:false|true)", plan)
        assert carried and all(x.startswith("revision#") and "," not in x for x in carried)


def test_texts_are_walked_once_for_rules_and_records(spark):
    from test_records import TOMBSTONE

    record = {"recordKind": "tombstone", "body": TOMBSTONE}
    shard = {"payloadVersion": 2, "nodeType": "shard", "partitionVersion": 1, "prefix": "", "records": [record]}
    texts = lambda x: spark.createDataFrame([("t", sj.canonical(x).encode()), ("broken", b"{")], "revision string, data binary")
    made = [*ingest.parse_shards(texts(shard)), *ingest.parse_records(texts([record]))]
    for df in made:
        assert "ArrowEvalPython" not in df._jdf.queryExecution().toString()
    assert [df.count() for df in made] == [1, 1, 1, 1]


def test_state_of_texts_gives_none_back(spark):
    texts = [b'{"a":1}', b'{"a": 1}', b"{", None, b'"\xff"', b'{"b":1,"a":1}']
    got = spark.createDataFrame([(t,) for t in texts], "t binary").select(sj.json_state("t").alias("s")).select("s.*").collect()
    assert [(r.refusal, r.same) for r in got] == [(None, True), (None, False), ("parse", False), ("empty", False), ("utf-8", False), (None, False)]


def test_roots_are_walked_in_one_step(spark):
    root = {"payloadVersion": 2, "nodeType": "root", "partitionVersion": 1, "parents": [], "entryCount": 0, "observationCount": 0, "requiredEpochs": [], "references": [{"prefix": "", "empty": True}]}
    got = ingest.preflight_roots(spark.createDataFrame([("r", sj.canonical(root).encode()), ("broken", b"{")], "revision string, data binary"))
    steps = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")
    # of what is left to run, only single references go to Python
    assert [steps(df) for df in (got.references, got.totals, got.violations)] == [0, 0, 1]
    assert {(r.identity, r.rule) for r in got.violations.collect()} == {("broken", "json: parse")} and got.totals.count() == 1


def test_records_are_made_by_the_walk_of_their_text(spark, monkeypatch):
    """One Python step for a text and all its records, and none for each record."""
    from test_records import TOMBSTONE

    made, written = [], ingest.written

    def kept(df, name):
        made.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, name)

    monkeypatch.setattr(ingest, "written", kept)
    record = {"recordKind": "tombstone", "body": TOMBSTONE}
    shard = {"payloadVersion": 2, "nodeType": "shard", "partitionVersion": 1, "prefix": "", "records": [record]}
    for parse, x in ((ingest.parse_records, [record]), (ingest.parse_shards, shard)):
        made.clear()
        rows, bad = parse(spark.createDataFrame([("t", sj.canonical(x).encode())], "revision string, data binary"))
        assert sum(plan.count("ArrowEvalPython") for plan in made) == 1
        assert [(r.kind, r.body) for r in rows.collect()] == [("tombstone", sj.canonical(TOMBSTONE))] and bad.count() == 0


def test_odd_arrays_of_records(spark):
    from test_records import TOMBSTONE

    fine = {"recordKind": "tombstone", "body": TOMBSTONE}
    cases = {
        "fine": sj.canonical([fine, fine]).encode(), "none": b"[]", "object": b'{"records":[]}', "number": b"5", "null": b"null", "broken": b"[", "spaced": json.dumps([fine]).encode(),
        "items": b'[null,5,"x",[],{}]', "turned": sj.canonical([fine]).encode().replace(b'{"body":', b'{"recordKind":"tombstone","body":').replace(b',"recordKind":"tombstone"}]', b"}]"),
        "bodies": b'[{"body":null,"recordKind":"tombstone"},{"recordKind":"tombstone"},{"body":{"a":1.50,"b":[]},"recordKind":null}]', "kinds": b'[{"body":{},"recordKind":5},{"body":{},"recordKind":["tombstone"]}]',
    }
    rows, bad = ingest.parse_records(spark.createDataFrame([(k, v) for k, v in cases.items()], "revision string, data binary"))
    found, held = {k: set() for k in cases}, {k: [] for k in cases}
    for r in bad.collect():
        found[r.identity].add(r.rule)
    for r in rows.collect():
        held[r.revision].append((r.kind, r.body))
    assert {k for k, rules in found.items() if not rules} == {"fine", "none"}
    assert all(found[k] == {"array"} for k in ("object", "number", "null")) and found["broken"] == {"json: parse"}
    assert found["spaced"] == found["turned"] == {"canonical"} and {"record: fields", "record: kind"} <= found["items"] and "canonical" in found["bodies"]
    assert held["spaced"] == held["turned"] == [("tombstone", sj.canonical(TOMBSTONE))] and held["fine"] == 2 * held["turned"]
    assert held["items"] == [(None, None)] * 5 and sorted(held["kinds"], key=str) == [("5", "{}"), (None, "{}")]
    assert sorted(held["bodies"], key=str) == [("tombstone", "null"), ("tombstone", None), (None, '{"a":1.5,"b":[]}')]


def test_walk_tells_what_read_tells():
    texts = ['[{"body":1,"recordKind":"x"}]', '{"prefix":"","records":[1]}', '{"records":[],"prefix":""}', '{"ﬁ":1,"\U0001f600":2,"records":[{"recordKind":1e3,"body":[]}]}', "[1.0]", '{"records":5}', "[" * 33 + "]" * 33, "[" * 32 + "]" * 32, '["\\ud800"]', "{}", '"x"']
    for t in texts:
        own = t.encode()
        refusal, text = sj.read(own)
        for member in (None, "records"):
            assert sj._state_of_records(own, member)[:2] == (refusal, text == t), t


def test_catalogs_are_walked_once_for_rules_and_records(spark):
    got = ingest.parse_catalogs(spark.createDataFrame([("r", catalog()), ("broken", b"{"), ("list", b"[1]")], "revision string, data binary"))
    for table in (got.violations, got.parents):
        assert "ArrowEvalPython" not in table._jdf.queryExecution().toString()
    assert {(r.rule, r.identity) for r in got.violations.collect()} >= {("json: parse", "broken"), ("fields", "list"), ("entries", "list")}
    assert "ArrowEvalPython" not in got.records._jdf.queryExecution().toString()
    assert sorted((r.revision, r.kind, r.identity, r.package) for r in got.records.collect()) == [("r", "observation", "o1", SHA), ("r", "snapshot", SHA, None)]
    assert {(r.revision, r.digest) for r in got.texts.collect()} == {("r", hashlib.sha256(sj.canonical(json.loads(catalog())).encode()).hexdigest()), ("broken", None), ("list", hashlib.sha256(b"[1]").hexdigest())}


def test_rules_are_compiled(spark):
    """A lambda around them would have all of them interpreted."""
    from basalt.operators.validate import violations

    rows = spark.createDataFrame([('{"a":"x"}',), ('{"a":"y"}',)], "body string").withColumn("c", F.from_json("body", "struct<a:string>"))
    found = violations(rows, F.col("body"), [("x", F.col("c.a") == "x"), ("never", F.col("c.a").isNull()), ("always", F.col("c.a").isNotNull())])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == [("never", '{"a":"x"}'), ("never", '{"a":"y"}'), ("x", '{"a":"y"}')]


def test_what_the_walk_tells_of_a_catalog():
    read = lambda value: sj._catalog(value if isinstance(value, bytes) else json.dumps(value).encode())
    odd = [{"entryKind": 5, "eventId": "e", "b": [sj._MARK, sj._MARK]}, {"entryKind": "tombstone", "eventId": "e", "targetPackageSha256": "t", "a": "\U0001f600"}, [sj._MARK], None, sj._MARK]
    for entries in (odd, odd[:1], odd[2:], [], [{"n": 1.5, "m": 1e21}, {"n": -0.0}]):
        got = read({"payloadVersion": 1, "parents": ["p", 5], "entries": entries, "observations": [{"observationId": "o", "packageSha256": "s"}] * 2, "more": {"z": 1, "a": 2}})
        assert [x[3] for x in got["records"]] == [sj.canonical(x) for x in entries] + ['{"observationId":"o","packageSha256":"s"}'] * 2
        assert (got["entries"], got["observations"], got["observed"], got["repeats"], got["version"], got["parents"]) == (len(entries), 2, 1, True, 1, ["p", None])
    got = read({"entries": odd, "observations": 1})
    assert [x[:3] for x in got["records"]] == [("5", "e", None), ("tombstone", "e", "t"), (None, None, None), (None, None, None), (None, None, None)]
    assert got.get("observations") is None and got.get("parents") is None and got.get("version") is None and got["repeats"]
    large = {"metadata": {"a": "\u00e9" * 40_000}, "locators": [1, 2]}
    got = read({"entries": [large, {"locators": None}], "observations": [], "payloadVersion": 1.0})
    assert (got["metadata"], got["locators"], got["repeats"], got.get("version")) == (80_008, 2, True, None)
    assert read(b'{"a":1,"a":1}') == {"refusal": "duplicate-key"} and list(read(b"5")) == ["digest"]
