import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from basalt.functions import crypto, scalars as fn, strict_json as sj
from basalt.plans import schemas

# Routing texts and their digests.
ROUTES = [
    ("snapshot", "b2447323ddb7161657fe9051dd9d4021a1187ca00d39e04124e52bb41651092c", "d5fc1e15203319ecf723405f137d09349b090e8c4f01509e8b028689ac4b5634"),
    ("tombstone", "AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA", "663b2d48058e26b5df90b418c9efe48282da16c13b9c9beddd7ce29c751f089f"),
    ("root-update-receipt", "gIGCg4SFhoeIiYqLjI2Oj5CRkpOUlZaXmJmam5ydnp8", "a36aba0429d835e54d481881ff3f95853fc219cb38271fe174acfe89dfc65725"),
    ("observation", "FFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFFY", "fd755c92333fe9f7f94a0275e8fc3c3caa109664e8d3de26249b4de065428c81"),
]


def test_route_vectors(spark):
    df = spark.createDataFrame(ROUTES, "kind string, identity string, want string")
    assert df.where(fn.route_hash(F.col("kind"), F.col("identity")) == F.col("want")).count() == 4


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_base64url_is_strict(spark):
    texts = ["", "AA", "AB", "AA==", "A", "AAA", "AAB", "a-_b", "a+/b", "AAAA\n"]
    assert column(spark, texts, "string", lambda c: F.hex(fn.base64url_bytes(c))) == ["", "00", None, None, None, "0000", None, "6BEFDB", None, None]
    data = [bytes(range(n)) for n in (*range(20), 57, 58, 200)]
    texts = [base64.urlsafe_b64encode(d).decode().rstrip("=") for d in data]
    assert [bytes(d) for d in column(spark, texts, "string", fn.base64url_bytes)] == data
    assert column(spark, data, "binary", fn.base64url) == [base64.urlsafe_b64encode(d).decode().rstrip("=") for d in data]
    assert column(spark, ["root"], "string", fn.label_id) == [base64.urlsafe_b64encode(hashlib.sha256(b"root").digest()).decode().rstrip("=")]


def test_hex_successor_and_sizes(spark):
    assert column(spark, ["00", "0f", "9f", "af", "fe", "ff"], "string", fn.hex_successor) == ["01", "10", "a0", "b0", "ff", None]
    assert column(spark, ["0", "01", "12", "-1", "1e3", "1" * 17], "string", fn.size_of) == [0, None, 12, None, None, None]
    urls = ["https://h.test/a/?q#f", "https://h.test", "http://h.test/a", "https://other/a"]
    assert column(spark, urls, "string", lambda c: fn.canonical_url(c, ("h.test",))) == ["https://h.test/a", "https://h.test", None, None]


def test_grammars(spark):
    at = ["2026-02-28T00:00:00Z", "2026-02-30T00:00:00Z", "2026-13-45T00:00:00Z", "2026-02-28T00:00:00.1234Z", "2026-02-28T00:00:00Z\n", None]
    assert column(spark, at, "string", schemas.is_timestamp) == [True] + [False] * 5
    assert column(spark, ["a" * 64, "a" * 64 + "\n", "A" * 64], "string", lambda c: c.rlike(schemas.DIGEST)) == [True, False, False]


REFUSED = {
    b"": "empty", b"  ": "empty", b"\xef\xbb\xbf{}": "bom", b"\xff": "utf-8", b'{"a":1,"a":2}': "duplicate-key", b'{"a":{"b":1},"b":2}': None,
    b"[1,]": "trailing-comma", b'{"a":1,}': "trailing-comma", b"[1]//x": "comment", b"/*x*/1": "comment", b"1 2": "trailing-token", b"{}}": "trailing-token",
    b'"\\ud800"': "surrogate", b'{"\\udc00":1}': "surrogate", b'"\\ud83d\\ude00"': None, b"1e999": "non-finite", b"[" * 33 + b"]" * 33: "depth", b"[" * 32 + b"]" * 32: None,
    b"[1": "parse", b"{1:2}": "parse", b'{"a" 1}': "parse", b"01": "parse", b"tru": "parse", b"[1 2]": "parse", b'"\x01"': "parse", b" null ": None, b"," * 2_000_000: "parse", b"NaN": "parse", b'{"a":}': "parse", b"[,1]": "parse",
}


@pytest.mark.parametrize("data,why", REFUSED.items(), ids=lambda x: str(x)[:24])
def test_strict_json(data, why):
    assert sj.refusal(data) == why
    if why is None:
        assert json.loads(sj.canonical(json.loads(data))) == json.loads(data)


def walked(data):
    """By the walk alone."""
    try:
        text = data.decode()
        sj._scan(text, 32)
    except UnicodeDecodeError:
        return "utf-8", None
    except sj.Refused as e:
        return str(e), None
    return None, sj.canonical(json.loads(text))


def test_reading_equals_the_walk():
    from hypothesis import given, settings, strategies as st

    some = [*REFUSED, b'{"b":1,"a":[2.50,-0,1e3,12345678901234567890]}', "{\"\U00010000\":1,\"\uffff\":2}".encode(), b'{"a":"\\u0001\\/","A":"[[["}', b"-0", b"[-0.0]", b'["\\u00e9"]', b"9007199254740993", b"1" * 400]
    some += [b'{"x":' * 32 + b"1" + b"}" * 32, b'{"x":' * 33 + b"1" + b"}" * 33, b'["' + b"[" * 50 + b'"]', b'["\\"[[",' + b"[" * 31 + b"]" * 31 + b"]", b"[" * 5000 + b"]" * 5000]
    for data in some:
        if data and not data.startswith(b"\xef\xbb\xbf"):
            assert sj.read(data) == walked(data), data[:40]

    @settings(max_examples=1500, deadline=None)
    @given(st.one_of(st.text(alphabet=st.sampled_from('{}[]:,"\\u0dea1-.eE \n/tn'), max_size=14), st.recursive(st.one_of(st.none(), st.integers(), st.floats(), st.text(max_size=3)), lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(st.text(max_size=2), x, max_size=3))).map(json.dumps)))
    def agrees(text):
        data = text.encode()
        if data:
            assert sj.read(data) == walked(data)

    agrees()


def test_canonical_text(spark):
    value = {"b": [1.0, 1e21, 1e-7, 0.1, -0.0, 123456789012345680000], "a": {"\U00010000": 1, "￿": None}, "é": True}
    assert sj.canonical(value) == '{"a":{"\U00010000":1,"￿":null},"b":[1,1e+21,1e-7,0.1,0,123456789012345680000],"é":true}'
    assert column(spark, [b'{"a":1}', b'{"a": 1}', b"{"], "binary", sj.is_canonical) == [True, False, False]
    ones = ["1", "1.0", "10e-1", "0.1E+1", "1.01", "2", "1e", "0" * 70]
    assert column(spark, ones, "string", sj.decimal_one) == [True] * 4 + [False] * 4
    versions = {
        '{"header":{"version": 1.0}}': "1.0", '{"header":{"version":1,"version":2}}': None, "{}": None, '{"version":1}': None, '{"header":[{"version":1}]}': None, '[{"header":{"version":1}}]': None, '{"header":{"version":"1"}}': None,
        '{"body":{"version":2},"header":{"a":{"version":3},"version":10e-1,"b":["version",{"version":4}]},"version":5}': "10e-1", '{"x":"\\"header\\":{\\"version\\":7}","header":{"version":-1}}': "-1", '{"header":{"version":{"version":1}}}': None,
        '{"header":{"\\u0076ersion":1e0}}': "1e0", '{"header":{"version":1}': None, '{"header":{"a":[],"c":{},"version":0.1E+1}}': "0.1E+1",
    }
    assert column(spark, list(versions), "string", sj.version_token) == list(versions.values())


def test_envelopes(spark):
    # RFC 5869, test case 1
    key = crypto.hkdf_extract(bytes(range(13)), b"\x0b" * 22)
    assert crypto.hkdf_expand(key, bytes(range(0xF0, 0xFA))).hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf"
    df = spark.createDataFrame([(b"text", b"k" * 32, b"n" * 12, b"head")], "p binary, k binary, n binary, h binary")
    sealed = df.withColumn("s", crypto.seal(F.col("p"), F.col("k"), F.col("n"), F.col("h")))
    r = sealed.select(crypto.unseal(F.col("s"), F.col("k"), F.col("h")).alias("ok"), crypto.unseal(F.col("s"), F.col("k"), F.lit(b"other")).alias("no"), "s").first()
    assert bytes(r.ok) == b"text" and r.no is None and bytes(r.s[:12]) == b"n" * 12 and len(r.s) == 12 + 4 + 16
    derived = df.select(crypto.expand_key("k", "h").alias("e"), F.length(crypto.random_bytes(16)).alias("n")).first()
    assert bytes(derived.e) == crypto.hkdf_expand(b"k" * 32, b"head") and derived.n == 16
