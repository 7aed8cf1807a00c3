import random

import pytest
from pyspark.sql import functions as F

from basalt.operators import shards
from basalt.operators.ordered import Ordered


@pytest.fixture
def many_ranges(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_equals_brute_force(spark, many_ranges):
    pick = random.Random(9)
    # a group over many ranges, groups inside one, null groups, values that are null
    rows = [(pick.choice(["hot"] * 6 + ["a", "b", None, "z"]), i, pick.choice([None, 1, 5, -2, 10**12])) for i in pick.sample(range(10_000), 900)]
    df = spark.createDataFrame(rows, "g string, at int, v bigint").repartition(7)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    table = Ordered(df, ["g"], [F.col("at")])
    got = {(r.g, r.at): r for r in table.neighbours({"b": "v", "was": "at"}, {"a": "v"}).collect()}
    sums = {(r.g, r.at): r.total for r in table.running_sum("v", "total").collect()}
    assert len(got) == len(sums) == len(rows)
    total = 0
    for i, (g, at, v) in enumerate(order):
        left = order[i - 1] if i and order[i - 1][0] == g else None
        right = order[i + 1] if i + 1 < len(order) and order[i + 1][0] == g else None
        r = got[g, at]
        assert (r["_first"], r["_last"], r.b, r.was, r.a) == (left is None, right is None, left and left[2], left and left[1], right and right[2])
        total = (total if left else 0) + (v or 0)
        assert sums[g, at] == total
    whole = Ordered(df, [], [F.col("at")]).running_sum("v", "total")
    assert max((r.at, r.total) for r in whole.collect())[1] == sum(v or 0 for *_, v in rows)
    none = Ordered(df.where("false"), ["g"], [F.col("at")])
    assert none.neighbours({"b": "v"}).count() == none.running_sum("v", "total").count() == 0


def cover(prefixes, width=4):
    """Rules broken, by the definition."""
    out, before = [], None
    rows = sorted((p.ljust(width, "0"), p) for p in prefixes)
    for i, (start, p) in enumerate(rows):
        if before is None:
            rule = None if start == "0" * width else "first"
        elif start <= before:
            rule = "overlap"
        else:
            rule = None if int(start, 16) == int(before, 16) + 1 else "gap"
        before = p.ljust(width, "f")
        out.append((p, rule or ("last" if i + 1 == len(rows) and before != "f" * width else None)))
    return sorted(x for x in out if x[1])


def test_covers_of_many_manifests(spark, many_ranges):
    pick, manifests = random.Random(2), {}
    for k in range(60):
        own = [""]
        for _ in range(pick.randint(0, 6)):
            p = pick.choice([x for x in own if len(x) < 4])
            own.remove(p)
            own += [p + d for d in "0123456789abcdef"]
        if k % 3 == 1:
            own.remove(pick.choice(own))
        if k % 3 == 2:
            own.append(pick.choice(own) if k % 2 else pick.choice(own)[:-1] + "7")
        manifests[k] = own
    df = spark.createDataFrame([(k, p) for k, own in manifests.items() for p in own], "revision int, prefix string").repartition(5)
    found = {k: [] for k in manifests}
    for r in shards.cover_violations(df, width=4, group=["revision"]).collect():
        found[r.revision].append((r.prefix, r.rule))
    assert {k: sorted(v) for k, v in found.items()} == {k: cover(own) for k, own in manifests.items()}
    assert any(found.values()) and not all(found.values())


def test_first_shard_beyond_the_budget(spark, many_ranges):
    rows = [(k, i, (k * 37 + i * 11) % 50) for k in range(40) for i in range(k * 5)]
    df = spark.createDataFrame(rows, "revision int, position int, length bigint").repartition(6)
    want = {}
    for k in range(40):
        used = 0
        for i in range(k * 5):
            used += (k * 37 + i * 11) % 50
            if used > 1000:
                want[k] = (i, used)
                break
    assert want and {r.revision: (r.position, r.used) for r in shards.over_budget(df, "revision", "position", "length", 1000).collect()} == want
