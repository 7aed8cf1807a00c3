import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb

from basalt.llm import resampling
from basalt.llm.numbering import numbered
from basalt.llm.queries import OP12, op12_importance_resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text):
    w = words(text)
    return [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25):
    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    rows = []
    for i, x in docs:
        own = features(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x)) >= 20])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def order(rows):
    return sorted(rows, key=repr)


def test_words_are_the_pattern():
    cut = resampling.Words()
    texts = ["", "a", "...", "\x00A\x7fb\x80c", "É ÉA\x01z", "😀x y", "a\nB9", "x" * 3000 + " é" * 3000, "ß.ß"]
    for piece in (1, 7, 1 << 20):
        resampling.PIECE = piece
        assert [[w.decode() for w in cut.of(t.encode())] for t in texts] == [words(t) for t in texts]


def test_any_words():
    from hypothesis import given, settings, strategies as st

    cut = resampling.Words()

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aZ0 .éİ\x00\x7f\x80"), st.characters(exclude_categories=["Cs"])), max_size=20))
    def agrees(text):
        assert [w.decode() for w in cut.of(text.encode())] == words(text)
        assert sorted(resampling.feature_buckets([w.encode() for w in words(text)], 2, 10000).tolist()) == sorted(features(text))

    agrees()


def test_equals_brute_force(spark):
    said = [None, "", "a b", "X y z. " * 9, "the cat sat " * 30, "é ü " * 4000, "w" * 40_000 + " a" * 30]
    docs = [(k if k % 7 else None, f"{x or ''} t{k % 5} " * 3 if k > 20 else x) for k, x in enumerate(said * 12)] + [(5, "the cat sat " * 30)] * 40
    target = [None, "", "the cat sat on t1", "é ü"]
    df = spark.createDataFrame([(i, x, 1, 2, 3) for i, x in docs], "doc_id bigint, text string, words int, rank int, buckets int").repartition(5)
    aim = spark.createDataFrame([(x, 1) for x in target], "text string, buckets int")
    got = [tuple(r) for r in resampling.resample(df, aim).collect()]
    assert order(got) == order(brute(docs, target))
    assert order(map(tuple, resampling.resample(df, aim.where("false"), percent=100).collect())) == order(brute(docs, [], 100))
    assert resampling.resample(df.where("false"), aim).count() == 0


def test_numbers_are_given_once(spark):
    df = spark.range(2000).selectExpr("id % 3 AS k", "id AS v").repartition(7)
    got = numbered(df.where("k <> 1"), [df["k"].desc()], "place").collect()
    assert sorted(r.place for r in got) == list(range(1, len(got) + 1)) and {r.v for r in got} == {v for v in range(2000) if v % 3 != 1}
    assert max(r.place for r in got if r.k == 2) < min(r.place for r in got if r.k == 0)
    assert numbered(df.where("false"), [df["k"]], "place").count() == 0


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(OP12), op12_importance_resampling(spark, SF)
    rows = order(map(tuple, got.collect()))
    assert got.columns == want.columns and rows == order(want.fetchall())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows == order(brute(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]))
