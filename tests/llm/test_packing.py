import zlib

import numpy as np
from tokenizers import Tokenizer

from basalt.llm import packing
from basalt.llm.queries import op4_packing, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x205F, 0x3000, 0x180E, 0x200B, 0xFEFF]))
TEXTS = [None, "", "  ", "é ́x I'll DON'T 3.14 <|endoftext|>", "a".join(SPACES), "ΣΣ İ ﬁ \U0001f600‍\U0001f600 하", "word " * 30_000, "z" * 50_000, "x"]
TEXTS += ["İ.", "Zİ:", "İ!", "\ufb2a.", "a<|endoftext|>b", "<|startoftext|> <|ENDOFTEXT|>. x<|endoftext|>, y", "e\u0301. E\u0301!", "ſ. K;"]


def library():
    return Tokenizer.from_file(PATH)


def check(got, texts, tok):
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in texts.items()}
    seen, axis = {}, []
    for r in got:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.length > 0 and r.doc_tokens == len(want[r.doc_id]) and zlib.crc32(ids) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        axis.append((r.sequence_id * 4096 + r.offset, r.length))
        assert r.offset + r.length <= 4096
    for i, ids in want.items():
        at = 0
        for start, n in sorted(seen[i]):
            assert start == at
            at += n
        assert at == len(ids)
    at = 0
    for start, n in sorted(axis):
        assert start == at
        at += n


def test_words_equal_library():
    tok, table = library(), packing.word_ids(PATH)
    for t in TEXTS:
        assert np.frombuffer(table.of(t or ""), table.dtype).tolist() == tok.encode(t or "", add_special_tokens=False).ids


def test_pack_equals_brute_force(spark):
    from pyspark.sql import functions as F

    texts = dict(enumerate(TEXTS * 3))
    for parts in (1, 5):
        df = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()], "doc_id bigint, text string, part int, start int").repartition(parts)
        got = packing.pack(df, PATH).withColumn("ids_crc32", F.crc32("ids")).collect()
        check(got, texts, library())
    assert packing.pack(df.where("false"), PATH).count() == 0


def test_query_over_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    check(op4_packing(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}, library())


def test_any_words_equal_library():
    from hypothesis import given, settings, strategies as st

    tok, table = library(), packing.WordIds(PATH)

    @settings(max_examples=1500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("abTHEéÉßıİŉſþ'.,!s0 ́ªº"), st.characters(max_codepoint=0x250, exclude_categories=["Cs"])), max_size=12))
    def agrees(text):
        assert np.frombuffer(table.of(text), table.dtype).tolist() == tok.encode(text, add_special_tokens=False).ids

    agrees()
