"""The pipeline against plain Python versions of its stages."""

import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from basalt.llm import secret_scan as ss
from basalt.llm.queries import tokenizer_path
from test_minhash import brute as near
from test_secret_scan import RULES, base

SF = "/root/testdata/sf0.001"


def masked(docs):
    """docs: {id: (text, source, lang)}. Live base and bare spans become [SECRET]."""
    owners, repos, spans = {}, {}, {}
    sample = lambda v: re.search("(?i)example|sample|dummy|placeholder", v)
    copied = lambda v: len(owners[v]) >= 3 or len(owners[v]) > 1 and len(repos[v]) >= 6
    alike = lambda v: len(re.findall("[0-9]", v)) >= 3 and len(re.findall("[A-Za-z]", v)) >= 2 and len(set(v)) >= 10 and not re.search("(?i)example|sample|dummy|placeholder", v)
    for i, (t, source, lang) in docs.items():
        own = []
        for s, k, e in base(t):
            own.append((s, e, RULES[k][1].match(t, s)[2] if k == 0 else t[s:e]))
        own += [(m.start(), m.end(), m[0]) for m in re.finditer(ss.BARE, t) if alike(m[0]) and not any(m.start() < e and s < m.end() for s, e, _ in own)]
        spans[i] = own
        for *_, v in own:
            owners.setdefault(v, set()).add(source)
            repos.setdefault(v, set()).add((source, lang))
    out = {}
    for i, (t, *_) in docs.items():
        at, new = 0, ""
        live = sorted((s, e) for s, e, v in spans[i] if not copied(v) and not sample(v))
        for s, e in live:
            if s >= at:
                new += t[at:s] + "[SECRET]"
            at = max(at, e)
        out[i] = new + t[at:]
    return out


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.drop_toxic(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {r.doc_id: (r.text or "", r.source, r.lang) for r in kept.collect()}
    clean = [i for i, y in labels.items() if not y]
    assert sum(i in left for i in clean) > 0.95 * len(clean)
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i][0]), i)
    left = {i: left[i] for i in first.values()}
    groups = near({i: t for i, (t, *_) in left.items()}, 80)
    left = {i: x for i, x in left.items() if groups[i][1] == i}
    texts = masked(left)
    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in texts.items()}
    got = cp.run(spark, SF).collect()
    pieces = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert {i: [x for _, p in sorted(v) for x in p] for i, v in pieces.items()} == want
    ends = sorted((r.sequence_id * 4096 + r.offset, r.length) for r in got)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_nulls_and_repeats_survive(spark):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (None, "a b", None, None, None), (2, "a  b", "en", "s", 4), (3, "secret=aB3dE5gH7jK9mN " + "w " * 9, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(((r.doc_id, r.text) for r in cp.drop_copies(spark, docs, SF).collect()), key=str) == sorted([(1, None), (2, "a  b"), (3, rows[4][1])], key=str)
    assert cp.drop_near_copies(spark, docs, SF).count() == 4  # the null id's text equals that of 2
    got = {(r.doc_id, r.text, r.n_chars) for r in cp.mask_secrets(spark, docs, SF).collect()}
    text = "[SECRET] " + "w " * 9
    assert (3, text, len(text)) in got and (None, "a b", None) in got
    none = docs.where("false")
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, none, SF).count() == 0


def test_extra_columns_of_clashing_names(spark):
    """Every stage carries columns named like its own, and n_chars where it is wanted."""
    extra = ["toxicity", "live", "__id", "__hash", "gone_id", "masked", "found_id", "kept", "row", "rep", "h1", "keep", "n", "ids", "part"]
    rows = [(i, f"token=aB3dE5gH7jK9m{i} and words {i}", "en", "s", 1, *(f"{c}{i}" for c in extra)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in extra))
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        assert {tuple(r)[5:] for r in got.collect()} == {tuple(r)[5:] for r in rows}
    assert cp.pack(spark, docs, SF).count() == 4


def test_empty_table_of_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert cp.drop_toxic(spark, none, SF).count() == 0


def test_near_copies_from_four_fifths_go(spark):
    def changed(text, n):
        w = text.split()
        for k in range(n):
            w[10 + 40 * k] = f"other{k}"
        return " ".join(w)

    a, b = (" ".join(f"{c}{i}" for i in range(300)) for c in "ab")
    # of 296 shingles each change takes 5: similarities 271/321, 266/326 and 261/331
    texts = {1: a, 2: changed(a, 5), 3: changed(a, 6), 11: b, 12: changed(b, 7)}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r.doc_id for r in cp.drop_near_copies(spark, docs, SF).collect()}
    assert kept == {i for i, (_, first) in near(texts, 80).items() if i == first} == {1, 11, 12}
