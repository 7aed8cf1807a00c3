import random

import duckdb
import xxhash
from pyspark.sql import functions as F

from basalt.llm import digests, url_filter
from basalt.llm.queries import OP13, URL_RULES, op13_url_filter

SF = "/root/testdata/sf0.001"


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for rule, verdict in rules.items():
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or (len(rule.encode()), len(h.encode())) > best[0]):
            best = ((len(rule.encode()), len(h.encode())), rule, verdict)
    return (host, path, None, "allow") if best is None else (host, path, *best[1:])


def judged(spark, urls, rules, **more):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, rule string").repartition(3)
    table = spark.createDataFrame([*rules.items(), (None, "block"), ("com/", None)], "rule string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge(pages, url_filter.compile_rules(table, **more)).collect()}
    return [got[i] for i in range(len(urls))]


def test_rules_of_any_host_and_path(spark):
    rules = {**URL_RULES, "é.org/ü": "block", "org": "block", "a.b/": "block", "b/xyz": "allow", "x.com:8080/": "block", "/": "block"}
    urls = [None, "", "x", "://", "http://", "HTTP://Example.COM/en/a?b#c", "http://example.com", "http://example.com/EN/", "https://notexample.com/en/x", "http://a.www.example.com/en/", "http://com/", "http://.com/"]
    urls += ["http://net/es/1", "http://x.net/fr/2?u=http://example.com/en/", "http://É.org/ü", "http://é.org/üx", "http://q.é.org/u", "http://a.b/xyz", "http://x.com:8080/", "http://x.com#/en/", "x://y://com/", "http://com./", "http://é.ORG"]
    urls += ["http://" + "a." * 50_000 + "example.com/en/" + "z" * 50_000, "http:///x", "http://x.com/\nen"] * 2
    assert judged(spark, urls, rules) == [brute(u, rules) for u in urls]
    assert judged(spark, urls, {}) == [brute(u, {}) for u in urls]


def test_many_rules_in_many_shards(spark):
    pick = random.Random(1)
    word = lambda: pick.choice("abc") * pick.randint(1, 2)
    rules = {".".join(word() for _ in range(pick.randint(1, 3))) + "/" + "".join(word() + "/" for _ in range(pick.randint(0, 2))): pick.choice(["allow", "block"]) for _ in range(400)}
    urls = ["http://" + ".".join(word() for _ in range(pick.randint(1, 5))) + "/" + "".join(word() + pick.choice("/?") for _ in range(3)) for _ in range(800)]
    assert judged(spark, urls, rules, per_shard=20) == [brute(u, rules) for u in urls]


def test_strings_decide_where_hashes_are_equal(spark, monkeypatch):
    keys = spark.createDataFrame([(b"one", 1), (b"two", 2), ("é".encode(), 3)], "key binary, value bigint")
    assert [r.h % 2**64 for r in keys.select(F.xxhash64("key").alias("h")).collect()] == [xxhash.xxh64_intdigest(k, 42) for k in (b"one", b"two", "é".encode())]
    table = digests.build(keys, "test")
    assert digests.look_up(table, [b"two", b"none", b"one", "é".encode(), b"two", b""]).tolist() == [2, -1, 1, 3, 2, -1]
    assert digests.look_up(table, []).tolist() == []
    import numpy as np

    hashes = digests.load(table.root, "hashes-0")
    same = {f"{table.root}/{n}-0": digests.load(table.root, f"{n}-0") for n in ("places", "bytes", "values")} | {f"{table.root}/hashes-0": np.full(len(hashes), 7, np.uint64)}
    monkeypatch.setattr(digests, "load", lambda root, name: same[f"{root}/{name}"])
    monkeypatch.setattr(digests.xxhash, "xxh64_intdigest", lambda *_: 7)
    assert digests.look_up(table, [b"two", b"none", b"one", "é".encode()]).tolist() == [2, -1, 1, 3]


def test_both_verdicts_block_and_empty_tables(spark):
    rules = url_filter.compile_rules(spark.createDataFrame([("Com/", "allow"), ("com/", "block"), ("com/", "allow")], "rule string, verdict string"))
    pages = spark.createDataFrame([(None, "http://a.com/")] * 2, "page_id bigint, url string")
    assert [tuple(r) for r in url_filter.judge(pages, rules).collect()] == [(None, "a.com", "/", "com/", "block")] * 2
    assert url_filter.judge(pages.where("false"), rules).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = con.sql(OP13)
    got = op13_url_filter(spark, SF)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert {r.verdict for r in got.collect()} == {"allow", "block"}
