import base64
import hashlib
import json


from basalt.functions import strict_json as sj
from basalt.sources import packages

# A package of the format, with its secret, and the digests of what it must become.
SECRET = bytes(range(32))
HEADER = {
    "vaultId": "QEFCQ0RFRkdISUpLTE1OTw", "vaultSalt": "ICEiIyQlJicoKSorLC0uLzAxMjM0NTY3ODk6Ozw9Pj8", "rootEpoch": "UFFSU1RVVldYWVpbXF1eXw", "scopeId": "YGFiY2RlZmdoaWprbG1ub3BxcnN0dXZ3eHl6e3x9fn8",
    "recordId": "gIGCg4SFhoeIiYqLjI2Oj5CRkpOUlZaXmJmam5ydnp8", "generationId": "oKGio6SlpqeoqaqrrK2ur7CxsrO0tba3uLm6u7y9vr8", "kind": "snapshot", "nonce": "wMHCw8TFxsfIycrL",
}
PAYLOAD = {
    "payloadVersion": 1,
    "metadata": {
        "network": {"id": "synthetic-local", "genesisHash": None}, "accountBinding": {"scheme": "synthetic-fixture", "value": "fixture-account"}, "applicationId": "wpp-vector-fixture",
        "contract": {"address": "synthetic-contract", "codeHash": None}, "privateStateIds": ["fixture-state"],
        "codec": {"id": "wpp.synthetic-vector", "version": 1, "producerPackage": "wpp-format-vectors", "producerVersion": "0.1.0", "sourceCommit": "0" * 40}, "capturedAt": "2026-09-19T00:00:00Z",
        "lifecycle": {"status": "unassociated", "transactionId": None, "blockHash": None}, "parents": [], "retentionClass": "retained-application-witness",
    },
    "content": {"counter": "12345678901234567890", "bytes": "AAECAw", "message": "PUBLIC SYNTHETIC TEST DATA"},
}
OBJECT_KEY = "d081e0775e3c5f21cb5cb0037de89441620823d6b6264c664d21feb1d97c9675"
WIRE_SHA256 = "b2447323ddb7161657fe9051dd9d4021a1187ca00d39e04124e52bb41651092c"

KIND = "name string, payload binary, header struct<" + ",".join(f"{k}:string" for k in HEADER) + ">, secret binary"


def sealed(spark, payload=None):
    df = spark.createDataFrame([("golden", payload or sj.canonical(PAYLOAD).encode(), tuple(HEADER.values()), SECRET)], KIND)
    return df, packages.seal_packages(df).first()


def opened(spark, wires, epochs=((HEADER["rootEpoch"], SECRET),)):
    kept, broken = packages.parse_packages(spark.createDataFrame(list(wires.items()), "name string, wire binary").repartition(3))
    out = {k: set() for k in wires}
    for r in broken.collect():
        out[r.identity].add(r.rule)
    got = packages.open_packages(kept, spark.createDataFrame(list(epochs), "epoch string, secret binary")).collect()
    return out | {r.name: r.failure or bytes(r.payload) for r in got}


def test_golden_package(spark):
    df, row = sealed(spark)
    assert bytes(packages.package_keys(df, "secret", "header").first().key).hex() == OBJECT_KEY
    assert row.sha256 == WIRE_SHA256 == hashlib.sha256(bytes(row.wire)).hexdigest()
    assert opened(spark, {"golden": bytes(row.wire)}) == {"golden": sj.canonical(PAYLOAD).encode()}


def flipped(text, at=0):
    """base64url with one bit changed."""
    data = bytearray(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    data[at] ^= 1
    return base64.urlsafe_b64encode(bytes(data)).decode().rstrip("=")


def test_every_changed_field_is_noticed(spark):
    wire = json.loads(bytes(sealed(spark)[1].wire))
    head = wire["header"]
    text = lambda w: sj.canonical(w).encode()
    cases = {"spaced": json.dumps(wire, indent=2).encode()}
    for k in HEADER:
        cases[k] = text(wire | {"header": head | {k: "catalog" if k == "kind" else flipped(head[k])}})
    for at in (0, 300, -1):
        cases[f"ciphertext {at}"] = text(wire | {"ciphertext": flipped(wire["ciphertext"], at)})
    cases["tag"] = text(wire | {"tag": flipped(wire["tag"], -1)})
    got = opened(spark, cases)
    assert got.pop("spaced") == sj.canonical(PAYLOAD).encode()
    assert got.pop("rootEpoch") == "epoch" and set(got.values()) == {"authentication"}
    assert opened(spark, {"x": text(wire)}, [(head["rootEpoch"], b"\x01" * 32)]) == {"x": "authentication"} and opened(spark, {"x": text(wire)}, [("other", SECRET)]) == {"x": "epoch"}
    _, odd = sealed(spark, b'{"b":1,"a":2}')
    assert opened(spark, {"odd": bytes(odd.wire)}) == {"odd": "payload"}


def test_wires_are_closed(spark):
    wire = json.loads(bytes(sealed(spark)[1].wire))
    head, text = wire["header"], lambda w: sj.canonical(w).encode()
    without = lambda d, k: {a: b for a, b in d.items() if a != k}
    cases = {
        "more": (text(wire | {"zone": 1}), {"closed"}), "inner": (text(wire | {"header": head | {"zone": None}}), {"closed"}), "no tag": (text(without(wire, "tag")), {"closed", "tag"}), "short tag": (text(wire | {"tag": "AAAA"}), {"tag"}),
        "format": (text(wire | {"header": head | {"format": "other"}}), {"header"}), "suite": (text(wire | {"header": head | {"suite": "none"}}), {"header"}), "kind": (text(wire | {"header": head | {"kind": "letter"}}), {"header"}),
        "id": (text(wire | {"header": head | {"scopeId": "A" * 43}}), None), "bits": (text(wire | {"header": head | {"vaultId": "A" * 21 + "B"}}), {"header ids"}), "nonce": (text(wire | {"header": head | {"nonce": "A" * 15}}), {"nonce"}),
        "padding": (text(wire | {"ciphertext": wire["ciphertext"] + "="}), {"ciphertext"}), "version 2": (text(wire | {"header": head | {"version": 2}}), {"version", "version token"}),
        "1.0": (text(wire).replace(b'"version":1', b'"version":1.0'), set()), "1.1": (text(wire).replace(b'"version":1', b'"version":1.1'), {"closed", "version", "version token"}), "twice": (text(wire).replace(b'"version":1', b'"version":1,"version":1'), {"json: duplicate-key"}),
    }
    got = opened(spark, {k: w for k, (w, _) in cases.items()})
    for k, (_, want) in cases.items():
        if want:
            assert got[k] == want, (k, got[k])
    assert got["1.0"] == sj.canonical(PAYLOAD).encode() and got["id"] == "authentication"


def test_query_deals_customers_out(spark):
    """One file of customers isn't one task of HMAC, AES and JSON."""
    from basalt.plans import catalog_queries as cq

    got = cq.queries()["sealed_packages"](spark, "/root/testdata/sf0.001")
    assert got.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
