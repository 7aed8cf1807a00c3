import random

import numpy as np

from basalt.llm import minhash as mh
from basalt.llm.queries import op10_minhash
from basalt.llm.words import shingle_set


def sets(text):
    w = (text or "").encode().lower().split()
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(texts, percent):
    """{id: (n, component)} by all pairs through shared shingles."""
    s = {i: sets(t) for i, t in texts.items()}
    root = {i: i for i in s}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i in s:
        for x in s[i]:
            by.setdefault(x, []).append(i)
    shared = {}
    for ids in by.values():
        for j in range(1, len(ids)):
            for i in ids[:j]:
                shared[i, ids[j]] = shared.get((i, ids[j]), 0) + 1
    for (i, j), n in shared.items():
        if 100 * n >= percent * (len(s[i]) + len(s[j]) - n):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i: (len(s[i]), find(i)) for i in s}


def near_texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = {}
    for g in range(12):
        own = [word() for _ in range(rng.choice((3, 6, 9, 40, 300, 900)))]
        for _ in range(rng.choice((1, 2, 8, 30))):
            w = list(own)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = word()
            texts[len(texts)] = rng.choice((" ", "\n", "  ")).join(w)
    for t in (None, "", "  \t", "One two", "one TWO", "a b c d e", "A B  c d e", "x " * 40_000, "É b c d e f"):
        texts[len(texts)] = t
    return texts


def test_components_equal_brute_force(spark):
    for percent in (80, 85):
        texts = near_texts(percent)
        df = spark.createDataFrame([(i, t, 1, "k") for i, t in texts.items()], "doc_id bigint, text string, rep int, key string").repartition(5)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(df, percent).collect()}
        assert got == brute(texts, percent)


def test_star_misses_are_found(spark, monkeypatch):
    """One band for all: members that don't link with the hub must still find each other."""
    monkeypatch.setattr(mh, "_bands", lambda reps: reps.selectExpr("1L AS key", "rep", "n"))
    texts = near_texts(3)
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in mh.near_duplicates(df, 85).collect()}
    assert got == brute(texts, 85)


def test_estimate_is_unbiased():
    rng = np.random.default_rng(1)
    both, a, b = (rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) for n in (3000, 700, 300))
    x, y = np.unique(np.concatenate([both, a])), np.unique(np.concatenate([both, b]))
    est, used = mh.estimate(mh.registers(x, 384), mh.registers(y, 384), len(x), len(y))
    assert used == 384 and abs(est - 0.75) < 0.09
    z = np.unique(rng.integers(0, 2**63, 3000, np.uint64) * np.uint64(2))
    assert abs(mh.estimate(mh.registers(x, 384), mh.registers(z, 384), len(x), len(z))[0]) < 0.01


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "q"), (3, None), (2, None)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in mh.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (None, None, True), (3, 3, True), (2, 2, True)], key=str)
    assert mh.near_duplicates(df.where("false")).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash(spark, sf).collect()}
    assert got == brute(texts, 85)


def test_shingles():
    assert len(shingle_set(b"")) == len(shingle_set(None)) == 0
    assert len(shingle_set(b"a b c d e f a b c d e")) == 6 == len(sets("a b c d e f a b c d e"))
