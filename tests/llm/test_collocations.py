import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from basalt.llm import collocations
from basalt.llm.queries import OP11, op11_collocations

SF = "/root/testdata/sf0.001"


def brute(docs, least=30, covered=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, n in f.items():
        found = {p: a for p, a in n.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        rows = []
        for p, a in found.items():
            if 100 * longer[p] >= covered * a:
                continue
            s, _, l, r = min((2000000 * a // (n[p[:k]] + n[p[k:]]), k, n[p[:k]], n[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-s, -a, " ".join(p).encode(), l, r))
        for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]):  # noqa: E741
            out.append((lang, k + 1, p.decode(), -a, l, r, total[lang], -s))
    return sorted(out)


def found(spark, docs, parts=5, **more):
    df = spark.createDataFrame([(lang, text, 1, "x", "y") for lang, text in docs], "lang string, text string, n int, hi string, word string").repartition(parts)
    return sorted(map(tuple, collocations.collocations(df, **more).collect()))


@pytest.fixture(scope="module")
def texts():
    pick = random.Random(3)
    words = ["a", "B", "cc", "é", "d\x00", "\x01", "\x1f", "e-f", "São", "z", " ", "q\x85"]
    said = [" ".join(pick.choices(words, range(12, 0, -1), k=pick.randint(1, 120))) for _ in range(900)]
    said = [re.sub(" ", lambda _: pick.choice([" "] * 40 + ["\t", "  ", ", ", ". ", "\n", "\r", "\x0b"]), x) for x in said]
    said += ["New York City Hall, new york city hall"] * 40 + ["new york", "...", "", None, "once only"] + ["the one " * 9000]
    return [(pick.choice(["en", "en", "en", "de", None, "und", "x y"]), x) for x in said]


def test_equals_brute_force(spark, texts):
    want = brute(texts)
    assert len(want) > 100 and {r[0] for r in want} == {"en", "de", "und", "x y"}
    assert found(spark, texts) == want
    assert found(spark, texts, 1, top=3, covered=100, least=5) == brute(texts, top=3, covered=100, least=5)
    assert found(spark, texts[:20], 2, least=1) == brute(texts[:20], least=1)


def test_ends_of_batches_and_partitions(spark, texts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        assert found(spark, texts, least=12) == brute(texts, least=12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        for name in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(name)


def test_nothing_to_find(spark):
    assert found(spark, [(None, None), ("en", ""), ("en", "a b")]) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(df).count() == 0


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 6 * 10**15
    row = spark.createDataFrame([((1 << 32) | 2, (3 << 32), big, big + 1, big + 2, big + 3, big + 4)], "hi bigint, lo bigint, n bigint, part1 bigint, part2 bigint, end1 bigint, end2 bigint")
    row = row.withColumn("part3", F.lit(0)).withColumn("end3", F.lit(0))
    assert tuple(row.select(collocations.best_cut().alias("c")).first().c) == min((2000000 * big // (l + r), k, l, r) for k, l, r in [(1, big + 1, big + 4), (2, big + 2, big + 3)])


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(OP11), op11_collocations(spark, SF)
    rows = sorted(map(tuple, got.collect()))
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    assert rows == brute([(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
