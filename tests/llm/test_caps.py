import numpy as np
import pytest

from basalt.llm import caps
from basalt.llm.queries import op8_cap_filters

NAN, INF = float("nan"), float("inf")


def brute(rows, least=0.98):
    """{position: (n_links, component)}; rows are (vec_id, vector, label)."""
    ok = [i for i, (_, v, l) in enumerate(rows) if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    link = {i: [] for i in range(len(rows))}
    by = {}
    for i in ok:
        by.setdefault((rows[i][2], len(rows[i][1])), []).append(i)
    pairs = 0
    for ids in by.values():
        x = np.array([rows[i][1] for i in ids], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in np.argwhere(x @ x.T >= least):
            if a != b:
                link[ids[a]].append(ids[b])
                pairs += a < b
    out = {}
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            todo += [j for j in link[todo.pop()] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out[i] = (len(link[i]), min(ids) if ids else None)
    return out, pairs


def clusters(seed=0, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        c = rng.normal(size=dim)
        for _ in range(rng.choice((1, 1, 2, 5, 60))):
            noise = rng.normal(size=dim) * rng.choice((0.0, 0.05, 0.1, 0.14))
            rows.append([len(rows), (c + noise).tolist(), int(g % 3)])
    return rows


@pytest.mark.parametrize("block", (1024, 8))
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rows = clusters()
    rows += [[900 + i, rows[0][1], 0] for i in range(40)] + [[950, rows[0][1], None], [951, None, 0], [952, [0.0] * 64, 0], [953, [NAN] * 64, 0], [954, [INF] + [1.0] * 63, 0], [955, [None] * 64, 0], [956, [1e200] * 64, 1], [957, [1e-200] * 64, 1], [958, [1.0, 2.0], 1], [959, [1.0, 2.01], 1], [960, [], 1], [3, rows[3][1], rows[3][2]], [None, rows[3][1], rows[3][2]], [None, None, 1]]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "vec_id bigint, embedding array<double>, label int, rep int, filter string").repartition(4)
    want, _ = brute([r if r[0] not in (956, 957) else [r[0], [1.0] * 64, 1] for r in rows])
    got = sorted(((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id if r.component_id is not None else -1, r.kept) for r in caps.near_vectors(df).collect()))
    exp = sorted((r[0] if r[0] is not None else -1, want[i][0], want[i][1] if want[i][1] is not None else -1, r[0] == want[i][1]) for i, r in enumerate(rows))
    assert got == exp


def test_recall_at_the_threshold():
    """Pairs at exactly 0.98 share a filter; the decoder finds all exceeding filters."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y
    c = caps.codes_for(64, 6, 2, 512, 12.0)
    lists = []
    for z in (x, y):
        row, filt = c.decode(z)
        lists.append([set(filt[a:b].tolist()) for a, b in zip(*(np.searchsorted(row, np.arange(len(z)) + k) for k in (0, 1)))])
    assert np.mean([bool(a & b) for a, b in zip(*lists)]) > 0.999
    for k, one in enumerate(c.codes):
        s = one.scores(x[:20])
        full = (s[0][:, :, None] + s[1][:, None, :]).reshape(20, -1)
        for i in range(20):
            want = set(np.flatnonzero(full[i] >= one.threshold).tolist()) or {int(full[i].argmax())}
            assert want == {f - k * c.span for f in lists[0][i] if k * c.span <= f < (k + 1) * c.span}


def test_query_over_whole_table_and_empty(spark):
    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    want, _ = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_cap_filters(spark, sf).collect()}
    assert got == {r[0]: want[i] for i, r in enumerate(rows)}
    assert caps.near_vectors(table.where("false")).count() == 0
