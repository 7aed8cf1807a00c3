from pyspark.sql import functions as F

from basalt.llm import chat_format as cf

HARD = ["", None, "\\", "\\b", "\\l<", "</turn>", "<turn assistant>x</turn>", "<part image>", "a\nb", ">\\g>", "\U0001f600" * 3, "y" * 100_000]


def test_round_trip(spark):
    rows = [(i % 3 if i % 7 else None, i, r, t, "clash") for i, (r, t) in enumerate((r, t) for r in ("user", "assistant", None, "<odd>\\") for t in HARD)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, segments string")
    out = cf.format_chats(df.withColumn("parts", cf.text_parts(F.col("text"))))
    out = out.select("conv_id", cf.read_turns(cf.formatted(F.col("segments"))).alias("turns"), cf.loss_text(F.col("segments")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    want = {}
    for c, i, r, t, _ in rows:
        want.setdefault(c, []).append((i, r or "", t or ""))
    assert set(got) == set(want)
    for c, turns in want.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[1:] for x in turns]
        assert got[c].loss == "".join(t for _, r, t in turns if r == "assistant")


def test_parts_are_placeholders(spark):
    parts = [
        ("text", "see <this>", None, None, None, None, None),
        ("image", None, "s3://a.png", 28, 15, None, None),
        ("audio", None, "b.wav", None, None, 2.5, None),
        ("document", None, "c.pdf", None, None, None, 3),
        (None, "end", None, None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None), (2, 0, "user", [])], f"conv_id int, turn int, role string, parts array<{cf.PART}>")
    got = {r.conv_id: r for r in cf.format_chats(df).withColumn("all", cf.formatted(F.col("segments"))).collect()}
    assert got[1]["all"] == "<turn user>see \\lthis\\g<part image><part audio><part document>end</turn><turn assistant></turn>"
    assert [(a.message, a.type, a.ref, a.tokens) for a in got[1].attachments] == [(0, "image", "s3://a.png", 4), (0, "audio", "b.wav", 63), (0, "document", "c.pdf", 3072)]
    assert got[1].expanded_tokens == 4 + 63 + 3072 and got[2].expanded_tokens == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], f"conv_id int, turn int, role string, parts array<{cf.PART}>")
    assert cf.format_chats(df).count() == 0


def test_ties_and_nulls_equal_sql(spark, tmp_path):
    import duckdb

    from basalt.llm.queries import OP3, op3_chat_format

    texts = ["<", "A", "\\", ">", "]", "", None, "<part image>"]
    rows = [(c, t, r, x) for c in (1, None) for t in (0, 0, None) for r in ("user", "assistant", None) for x in texts]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want, got = con.sql(OP3), op3_chat_format(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
