import hashlib

from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

import numpy as np
from basalt.llm import pieces
from basalt.llm.queries import op7_sentencepiece, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=PATH)
TEXTS = [None, "", " ", "  ", "\n", "\n\n a", "a  b   ", "▁a▁▁b", "<0x0A><s></s>\x00", "ﬁ é x\t\r\n", "\U0001f600" * 9, "q" * 30_000, "two words " * 20_000]


def agrees(text):
    ((ids, said),) = pieces.chunks(PATH).encode([text or ""])
    want = SP.encode(text or "")
    assert np.frombuffer(ids, "<i4").tolist() == want
    assert said == SP.decode(want)


def test_texts():
    assert pieces.chunks(PATH).cuts
    for t in TEXTS:
        agrees(t)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n▁abthe<>0x"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_any_text(text):
    agrees(text)


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {r.doc_id: SP.encode(r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_sentencepiece(spark, sf).collect()
    assert len(got) == len(want)
    for r in got:
        ids = want[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(SP.decode(ids)))


def test_chunks_come_from_the_table(spark, monkeypatch):
    """Every text of TEXTS is found whole in the table; other chunks, and hashes shared by two, are segmented."""
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    table = pieces.segmented(df, PATH)
    own = pieces.Chunks(PATH, table)
    segment, said = own.segment, []
    monkeypatch.setattr(own, "segment", lambda c: (said.extend(c), segment(c))[1])
    for t, (ids, text) in zip(TEXTS, own.encode([t or "" for t in TEXTS])):
        assert np.frombuffer(ids, "<i4").tolist() == SP.encode(t or "") and text == SP.decode(SP.encode(t or ""))
    assert not said
    assert own.encode(["unknown zzqx"])[0][0] and sorted(said) == [" unknown", " zzqx"]
    arrays = {"chunks-0": np.array([7, 7, 9], np.uint64), "ends-0": np.array([1, 2, 4]), "ids-0": np.arange(4, dtype="<i4"), "odd-0": np.array([2]), "said-0": np.frombuffer(b'["x"]', np.uint8)}
    monkeypatch.setattr(pieces, "load", lambda root, name: arrays[name])
    monkeypatch.setattr(pieces.xxhash, "xxh3_64_intdigest", {b"a": 7, b"b": 9, b"c": 3}.get)
    assert pieces.Table("x", 0, frozenset([0])).find(["a", "b", "c"]) == {"b": (arrays["ids-0"][2:].tobytes(), "x")}


def test_steps_keep_all_texts(monkeypatch):
    monkeypatch.setattr(pieces, "STEP", 3)
    assert list(pieces.steps(["a", None, "bcd", "e", "", "f"])) == [["a", "", "bcd"], ["e", "", "f"]]
    assert list(pieces.steps([])) == []


def test_empty_table(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "a b", 1), (1, "a b", 1)], "doc_id bigint, text string, ids int")
    assert sorted(len(r.ids) for r in pieces.encode(df, PATH).collect()) == [0, 2, 2]
    assert pieces.encode(df.where("false"), PATH).count() == 0
