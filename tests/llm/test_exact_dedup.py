import hashlib
import re

from pyspark.sql import functions as F

from basalt.llm.exact_dedup import exact_dedup, keep_first

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, run int, digest string"
TEXTS = [None, "", " ", "a  b", "a b", "a\tb", "a b", "x" * 200_000, "x" * 200_000, "\u0001"]


def rows(n=200):
    out = [(i, TEXTS[i % len(TEXTS)], "en", "s", 0, 1, "z") for i in range(n)]
    out += [(7, "again", "en", "s", 0, 1, "z")] * 2 + [(None, "again", "en", "s", 0, 1, "z"), (None, "lone", "en", "s", 0, 1, "z")]
    return out


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_groups_equal_brute_force(spark):
    for parts, fan_in in ((1, 16), (7, 2), (11, 3)):
        df = spark.createDataFrame(rows(), SCHEMA).repartition(parts)
        got = exact_dedup(df, fan_in=fan_in).collect()
        groups = {}
        for i, t, *_ in rows():
            groups.setdefault(norm(t), []).append(i)
        assert len(got) == len(rows())
        kept = {}
        for r in got:
            text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
            ids = [i for i in groups[text] if i is not None]
            assert r.group_size == len(groups[text])
            assert r.keep_id == (min(ids) if ids else None)
            kept[text] = kept.get(text, 0) + r.kept
            assert not r.kept or r.doc_id == r.keep_id
        assert set(kept.values()) == {1}


def test_keep_first_and_empty(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = keep_first(df)
    assert got.columns == df.columns
    texts = [norm(r.text) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({norm(t) for _, t, *_ in rows()})
    assert exact_dedup(df.where(F.lit(False))).count() == 0
    assert keep_first(df.where(F.lit(False))).count() == 0


def test_columns_of_any_name_are_kept(spark):
    names = ["__own", "__id", "__sha", "__repeat", "own_sha", "gone_id", "gone_sha", "gone_repeat", "_own_sha", "kept", "a.b"]
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in [(3, "x y"), (1, "x  y"), (2, "z"), (2, "z"), (None, None)]]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted({r for r in rows if r[0] != 3}, key=str)
