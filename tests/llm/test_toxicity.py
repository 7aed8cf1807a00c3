import zlib
from bisect import bisect_right
from math import exp, log, log1p

import numpy as np
import pytest

from basalt.llm import toxicity as tox
from basalt.llm.queries import op2_toxicity

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    for v in np.unique(s):
        rank[s == v] = rank[s == v].mean()
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def plain_features(text, lexicon):
    """The 15 features, one token and one loop at a time."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(tox.FEATURES)

    def units(w):
        inner = [c.isalnum() or c == "_" for c in w]
        if not any(inner):
            return []
        w = w[inner.index(True) : len(w) - inner[::-1].index(True)].lower()
        return [w] + [w[:k] + "*" for k in (4, 5, 6) if len(w) >= k]

    tier, hit, undone = [], [], []
    for w in words:
        best = max([(lexicon.get(u, 0), u) for u in units(w)] or [(0, "")])
        tier.append(best[0])
        hit.append(best[1])
        undone.append(0)
        if tox.MASKED.search(w) and not best[0]:
            letters = w.lower().translate(tox.UNMASK)
            once = "".join(c for i, c in enumerate(letters) if not i or c != letters[i - 1])
            for t in (letters, "".join(c for c in letters if c.isalnum()), once):
                undone[-1] = max([undone[-1]] + [lexicon.get(u, 0) for u in units(t)])
    n, strong = len(words), [i for i, t in enumerate(tier) if t == 2]
    you = [bool(units(w)) and units(w)[0] in tox.SECOND_PERSON for w in words]
    letters, capitals = (sum(f(c) for w in words for c in w) for f in (str.isalpha, str.isupper))
    shouted = sum(sum(map(str.isalpha, w)) > 2 and sum(map(str.isupper, w)) == sum(map(str.isalpha, w)) for w in words)
    other, digits = sum(not c.isalnum() for w in words for c in w), sum(c.isdigit() for w in words for c in w)
    return [
        log1p(n), 100 * len(strong) / n, log1p(len(strong)), 100 * tier.count(1) / n, log1p(tier.count(1)),
        log1p(sum(any(you[max(i - 5, 0) : i + 6]) for i in strong)), max(sum(t == 2 for t in tier[i : i + 25]) for i in range(n)),
        capitals / max(letters, 1), shouted / n, other / (max(letters, 1) + other), sum(w.count("!") + w.count("?") for w in words) / n,
        sum(bool(tox.MASKED.search(w)) for w in words) / n, log1p(undone.count(2)), log1p(len({hit[i] for i in strong})), digits / max(letters, 1),
    ]


def plain_probability(x, model):
    bins = [bisect_right(list(c), v) for c, v in zip(model.trees.cuts, x)]
    raw = model.trees.start
    for splits, leaf in model.trees.trees:
        node = 0
        for feature, cut in splits:
            node = 2 * node + (bins[feature[node]] > cut[node])
        raw += leaf[node]
    kx, ky = (list(k) for k in model.knots)
    i = bisect_right(kx, raw)
    p = ky[0] if not i else ky[-1] if i == len(kx) else ky[i - 1] + (ky[i] - ky[i - 1]) * (raw - kx[i - 1]) / (kx[i] - kx[i - 1])
    return 0.999 * p + 0.001 / (1 + exp(-raw))


def plain_boosting(x, y, rounds, depth, rate=0.15, smooth=5.0, bins=64):
    """Raw scores of greedy trees that try every feature and cut of every node."""
    cuts = [sorted(set(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))) for j in range(x.shape[1])]
    b = [[bisect_right(c, v) for c, v in zip(cuts, row)] for row in x]
    p = (sum(y) + 0.5) / (len(y) + 1)
    score = [log(p / (1 - p))] * len(y)
    worth = lambda rows, g, h: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + smooth)
    for _ in range(rounds):
        prob = [1 / (1 + exp(-s)) for s in score]
        g, h = [a - q for a, q in zip(y, prob)], [q * (1 - q) for q in prob]
        nodes = [list(range(len(y)))]
        for _ in range(depth):
            grown = []
            for rows in nodes:
                best, halves = 1e-9, (rows, [])
                for j in range(x.shape[1]):
                    for k in range(bins):
                        low, high = [i for i in rows if b[i][j] <= k], [i for i in rows if b[i][j] > k]
                        gain = worth(low, g, h) + worth(high, g, h) - worth(rows, g, h)
                        if gain > best + 1e-12:
                            best, halves = gain, (low, high)
                grown += halves
            nodes = grown
        for rows in nodes:
            step = rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + smooth)
            for i in rows:
                score[i] += step
    return score


def test_scores_equal_plain_version(spark):
    """Whole texts of a table and obfuscated ones, by a model trained on a table."""
    read = lambda sf, t: spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet")
    model = tox.fit(tox.labelled(read("sf0.01", "documents"), read("sf0.01", "labels")))
    assert model.trees and 2 in model.lexicon.values()
    bad = max((u for u, t in model.lexicon.items() if t == 2 and not u.endswith("*")), key=len)
    odd = [None, "", " \t", f"YOU {bad.upper()}!!! {bad}", f"{bad[0]}{bad} x {bad.replace('i', '1').replace('e', '3')} you", f"__{bad}__ ... 12 ¿tú?", f"{bad} " * 60]
    docs = read("sf0.001", "documents").select("doc_id", "text").union(spark.createDataFrame([(-i, t) for i, t in enumerate(odd, 1)], "doc_id bigint, text string"))
    got = tox.score(docs, model).collect()
    assert len(got) == docs.count()
    look = tox.Featurizer(model.lexicon)
    for r in got:
        x = plain_features(r.text, model.lexicon)
        assert look.of(r.text) == pytest.approx(x, rel=1e-9)
        assert r.toxicity == pytest.approx(plain_probability(look.of(r.text), model), rel=1e-9)


def test_training_equals_plain_version():
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 3)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=60) > 0).astype(float)
    assert tox.Trees().fit(x, y, rounds=3, depth=2).raw(x) == pytest.approx(plain_boosting(x, y, 3, 2), rel=1e-9)
    # isotonic regression by its minimax formula
    raw = rng.permutation(60).astype(float)
    kx, ky = tox.isotonic(raw, y)
    by = y[np.argsort(raw)]
    want = [max(min(by[j : k + 1].mean() for k in range(i, 60)) for j in range(i + 1)) for i in range(60)]
    assert sorted(set(np.round(want, 9))) == pytest.approx(list(np.round(ky, 9)))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op2_toxicity(spark, SF).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [i for i in labels if got[i].held_out]
    y, s = np.array([labels[i] for i in held]), np.array([got[i].score for i in held])
    assert auc(y, s) > 0.85 and ((s >= 0.5) == y).mean() > 0.93


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "a " * 100_000, 0.5), (2, "$#!+ 1d10t!!! IDIOT you", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id bigint, toxic int")
    model = tox.fit(tox.labelled(docs, labels))
    got = tox.score(docs, model)
    assert got.columns == ["doc_id", "text", "score", "toxicity"] and {r.toxicity for r in got.collect()} == {0.25}
    assert tox.score(docs.where("false"), model).count() == 0


def test_features_see_masks_and_neighbours():
    look = tox.Featurizer({"idiot": 2})
    at = dict(zip(tox.FEATURES, look.of("YOU, 1d10t and an idiot far away from there in a field")))
    assert at["strong"] == np.log1p(1) == at["masked_hits"] and at["near_you"] == np.log1p(1)
    assert dict(zip(tox.FEATURES, look.of("idiot a b c d e f g you")))["near_you"] == 0
    assert not look.of("").any()


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    t = tox.Trees().fit(x, y)
    assert ((t.raw(x) > 0) == y).mean() > 0.97
    kx, ky = tox.isotonic(np.array([3.0, 1, 2, 4]), np.array([0.0, 0, 1, 1]))
    assert (np.diff(kx) > 0).all() and ky.tolist() == [0, 0.5, 1]
