import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import arrays, ngrams
from basalt.llm.queries import op9_lm_scores

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.c = Counter(t for x in texts for t in tokens(x))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.pairs = Counter(p for x in texts for p in zip(["<s>", *tokens(x)], tokens(x)))
        self.after, self.cont = defaultdict(list), Counter()
        for (a, b), k in self.pairs.items():
            self.after[a].append(k)
            self.cont[b] += 1
        of = lambda values: [sum(v == k for v in values) for k in (1, 2, 3, 4)]
        self.high, self.low = (ngrams.discounts(of(list(x.values()))) for x in (self.pairs, self.cont))
        self.rest = sum(self.low[min(k, 3)] for k in self.cont.values()) / len(self.pairs)

    def p(self, a, b):
        k = self.cont[b]
        low = (k - self.low[min(k, 3)]) / len(self.pairs) + self.rest / (self.v + 1)
        if a not in self.after:
            return low
        total, c = sum(self.after[a]), self.pairs[a, b]
        return (c - self.high[min(c, 3)]) / total + sum(self.high[min(k, 3)] for k in self.after[a]) / total * low

    def row(self, text):
        t = tokens(text)
        base = sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(self.c[w] > 0 for w in t), self.n, base, sum(math.log10(self.p(a, b)) for a, b in zip(["<s>", *t], t))


def same(got, want):
    assert got[:3] == want[:3] and got[3:] == pytest.approx(want[3:], rel=1e-9)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    model = Brute([t for i, t in texts.items() if not out(i)])
    got = op9_lm_scores(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.held_out == out(r.doc_id)
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), model.row(texts[r.doc_id]))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    words = [*model.c, "unseen"]
    for a in ("<s>", "the", "unseen"):
        assert sum(model.p(a, b) for b in words) == pytest.approx(1)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "STEP", 3)
    monkeypatch.setattr(ngrams, "HELD", 5)
    monkeypatch.setattr(ngrams, "DISTINCT", 2)
    texts = [None, "", " \t\n", "a b A B a", "É é", "a b a b c", "w " * 3000, "a b A B a", " x y"]
    df = spark.createDataFrame([(i if i else None, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, shard int").repartition(3)
    model = ngrams.train(df, F.lit(True))
    brute = Brute(texts)
    got = ngrams.score(df, model).collect()
    assert len(got) == len(texts)
    for r in got:
        same((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), brute.row(texts[r.doc_id or 0]))
    none = ngrams.train(df, F.lit(False))
    assert {(r.base_score, r.score) for r in ngrams.score(df, none).collect()} == {(0.0, 0.0)}
    assert ngrams.score(df.where("false"), model).count() == 0


def test_packed_arrays():
    for kind in ("<u4", "<u8"):
        x = np.sort(np.random.default_rng(0).integers(0, 2**31, 1000)).astype(kind)
        assert (arrays.expand(arrays.squeeze(x, True), True) == x).all() and (arrays.expand(arrays.squeeze(x[::-1])) == x[::-1]).all()
        assert len(arrays.expand(arrays.squeeze(x[:0], True), True)) == 0
