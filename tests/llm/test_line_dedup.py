import random

import pytest
from pyspark.sql import functions as F

from basalt.llm import line_dedup as ld
from basalt.llm.queries import op5_line_dedup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def mutated(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at, what = rng.randrange(len(t) + 1), rng.randrange(3)
        if what == 0:
            t.insert(at, rng.choice("abcé\U0001f600"))
        elif t:
            at = min(at, len(t) - 1)
            t[at : at + 1] = [] if what == 1 else [rng.choice("abcé\U0001f600")]
    return "".join(t)


@pytest.mark.parametrize("limit", (1, 2, 3))
def test_edit_distance(spark, limit):
    rng = random.Random(limit)
    pairs = [("", ""), ("", "ab"), ("a", "b"), ("ab", "ba"), ("x" * 500, "x" * 499)]
    for _ in range(250):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 30)))
        pairs.append((a, mutated(rng, a, rng.randrange(0, limit + 3))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").repartition(2)
    got = {r.i for r in ld.within(df, "a", "b", limit).collect()}
    assert got == {i for i, (a, b) in enumerate(pairs) if distance(a, b) <= limit}
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    direct = df.where("length(a) <= length(b)").select("i", ld.edit_distance(chars("a"), chars("b"), limit).alias("d"))
    for r in direct.collect():
        d = distance(*pairs[r.i])
        assert r.d == d if d <= limit else r.d > limit


def brute(docs, limit, least, limited=distance, short=0):
    """{(doc_id, text): (n_lines, exact, near, dropped)}"""
    occ = sorted(((i is not None, i or 0), n, line) for i, t in docs for n, line in enumerate((t or "").split("\n")) if line.strip(" "))
    lines = sorted({o[2] for o in occ})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = sorted((x for x in lines if len(x) >= (short or least)), key=len)
    for k, a in enumerate(long):
        for b in long[k + 1 :]:
            if len(b) - len(a) > limit:
                break
            if find(a) != find(b) and limited(a, b) <= (limit if len(a) >= least else 1):
                root[find(a)] = find(b)
    first = {}
    for o in occ:
        first.setdefault(find(o[2]), o)
    out = []
    for i, t in docs:
        gone = [(n, line) for n, line in enumerate((t or "").split("\n")) if line.strip(" ") and first[find(line)][:2] != ((i is not None, i or 0), n)]
        exact = sum(first[find(line)][2] == line for _, line in gone)
        n = len((t or "").split("\n"))
        out.append((i, n, n - len(gone), exact, len(gone) - exact, ",".join(str(k) for k, _ in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", (1, 2, 3))
def test_classes_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(3, 60))) for _ in range(25)] + ["", " ", "ab", "z" * 3000]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.choice((0, 0, 1, 2, limit, limit + 1))) for _ in range(rng.randrange(1, 8)))) for i in range(60)]
    docs += [(70, None), (71, ""), (None, base[0]), (72, "\n\n"), (73, base[0] + "\n" + base[0])]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id int, text string, h1 int, line string").repartition(3)
    got = sorted((tuple(r) for r in ld.near_lines(df, limit, 8).collect()), key=str)
    assert got == brute(docs, limit, 8)


@pytest.mark.parametrize("limit", (1, 2, 3))
def test_hot_keys_equal_brute_force(spark, monkeypatch, limit):
    """All keys are hot, and short lines link within one edit."""
    monkeypatch.setattr(ld, "HOT", 0 if limit > 1 else 3)
    rng = random.Random(10 + limit)
    base = ["".join(rng.choice("abé😀") for _ in range(n)) for n in (9, 13, 17, 19, 20, 21, 24, 40)]
    docs = [(i, "\n".join(mutated(rng, rng.choice(base), rng.choice((0, 1, 1, 2, 2, limit, limit + 1, 2 * limit))) for _ in range(4))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    got = sorted((tuple(r) for r in ld.near_lines(df, limit, 20, 10).collect()), key=str)
    assert got == brute(docs, limit, 20, short=10)


def test_repeats_empty_and_removal(spark):
    df = spark.createDataFrame([(1, "same line\nsame line")] * 2, "doc_id int, text string")
    assert [tuple(r) for r in ld.near_lines(df).collect()] == [(1, 2, 1, 1, 0, "1")] * 2
    assert ld.near_lines(df.where("false")).count() == 0
    assert df.select(ld.without(F.lit("a\nb\n\nc"), F.lit("1,3"))).first()[0] == "a\n"


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]

    def quick(a, b):
        """More than 2 edits leave no third of ``a`` near its place in ``b``."""
        k = len(a) // 3
        if any(a[s : s + k] in b[max(0, s - 2) : s + k + 2] for s in (0, k, len(a) - k)):
            return distance(a, b)
        return 3

    assert sorted((tuple(r) for r in op5_line_dedup(spark, sf).collect()), key=str) == brute(docs, 2, 20, quick, 10)


def family(n, places):
    """Lines of one template that differ at some places."""
    out = []
    for k in range(n):
        t = list("service worker 0000 reported that all of its queues are empty, total xx and yy")
        for j, at in enumerate(places):
            t[at] = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ#$%&()*+/"[k // 71**j % 71]
        out.append("".join(t))
    return out


def spanned(lines, limit):
    """Component of each line by brute force."""
    root = list(range(len(lines)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for j in range(i):
            if find(i) != find(j) and sum(x != y for x, y in zip(a, lines[j])) <= limit:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(lines))]


@pytest.mark.parametrize("places", ((30, 70), (3, 4, 5)))
def test_dense_families_equal_brute_force(spark, places):
    lines = family(300, places) if len(places) == 2 else [family(71**2, places[:2])[k] for k in range(0, 300)]
    if len(places) > 2:
        rng = random.Random(len(places))
        lines = sorted({"".join(rng.choice("01234") if at in places else c for at, c in enumerate(lines[0])) for _ in range(250)})
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string").repartition(3)
    kept = {r.doc_id for r in ld.near_lines(df, 2, 20, 10).where("n_kept = 1").collect()}
    comp = spanned(lines, 2)
    assert kept == {min(i for i in range(len(lines)) if comp[i] == c) for c in set(comp)}


def test_a_family_of_thousands_is_one_star(spark):
    import time

    lines = family(5000, (30, 70))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string").repartition(4)
    began = time.time()
    assert [r.doc_id for r in ld.near_lines(df, 2, 20, 10).where("n_kept = 1").collect()] == [0]
    print(f"{time.time() - began:.0f} s")
    assert time.time() - began < 150
