import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from basalt.operators import layout
from basalt.operators.ordered_digest import ordered_digest, whole_digest


def sha(texts):
    return hashlib.sha256(b"[" + b",".join(t.encode() for t in texts) + b"]").hexdigest()


def test_equals_brute_force_at_every_batch_size(spark):
    pick = random.Random(5)
    rows = [(pick.choice(["a", "b", None, "hot", "hot", "hot"]), pick.choice([1, 2, None]), pick.choice([None, 3, 5, 5]), pick.choice([None, "é", "x" * 40, "y", "y"]), pick.choice([None, 7, -2])) for _ in range(3000)]
    want = defaultdict(list)
    for g, h, *rest in rows:
        want[g, h].append(rest)
    first = lambda x: (x is not None, x)
    expected = {k: (len(v), sum(n or 0 for *_, n in v), sha([t for _, t, _ in sorted(v, key=lambda r: (first(r[0]), first(r[1]))) if t is not None])) for k, v in want.items()}
    df = spark.createDataFrame(rows, "g string, h int, o int, t string, n int").repartition(5)
    try:
        for size in ("1", "7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = ordered_digest(df, ["g", "h"], [F.col("o")], F.col("t"), {"total": F.col("n")})
            assert got.columns == ["g", "h", "total", "records", "fingerprint"]
            assert {(r.g, r.h): (r.records, r.total, r.fingerprint) for r in got.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordered_digest(df.where("false"), ["g"], [F.col("o")], F.col("t")).count() == 0


def test_one_large_group_is_one_digest(spark):
    n = 300_000
    df = spark.range(0, n, 1, 16).select(F.lit("g").alias("g"), (-F.col("id")).alias("o"), F.concat(F.col("id").cast("string"), F.repeat(F.lit("z"), 50)).alias("t"))
    row = ordered_digest(df, ["g"], [F.col("o")], F.col("t")).first()
    assert row.records == n and row.fingerprint == sha(f"{i}{'z' * 50}" for i in range(n - 1, -1, -1))


def test_flat_commit_of_nothing(spark):
    some = spark.createDataFrame([("1", "x")], "id string, payload string")
    none = some.where("false")
    assert layout.flat_commit(none, none).first().asDict() == {"records": 0, "fingerprint": sha([]), "no_change": True}
    assert layout.flat_commit(none, some).first().asDict() == {"records": 1, "fingerprint": sha(["x"]), "no_change": False}


def test_a_flat_revision_is_joined_by_ranges_before_its_one_task(spark):
    pick = random.Random(6)
    rows = [(pick.choice([None, *range(4000)]), pick.choice([None, "é", "x" * 90, f"y{i}"])) for i in range(5000)]
    first = lambda x: (x is not None, x)
    want = sha([t for _, t in sorted(rows, key=lambda r: (first(r[0]), first(r[1]))) if t is not None])
    df = spark.createDataFrame(rows, "o int, t string").repartition(5)
    got = whole_digest(df, [F.col("o")], F.col("t"))
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert [(r.records, r.fingerprint) for r in got.collect()] == [(5000, want)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    nulls = whole_digest(df.withColumn("t", F.lit(None).cast("string")), [F.col("o")], F.col("t")).first()
    assert (nulls.records, nulls.fingerprint) == (5000, sha([])) and whole_digest(df.where("false"), [F.col("o")], F.col("t")).count() == 0
    # only one task takes all, and what it takes are pieces
    flat = layout.flat_commit(*[df.select(F.col("o").cast("string").alias("id"), F.col("t").alias("payload"))] * 2)
    assert "rangepartitioning(o0" in flat._jdf.queryExecution().executedPlan().toString() and flat.first().records == 5000
