import random

import pytest

from basalt.operators.validate import CatalogError
from basalt.sources.versions import ObjectLog


def objects(spark, rows):
    return spark.createDataFrame([(k, "data" if k != "m" else "manifest", v) for k, v in rows.items()], "key string, role string, data binary")


def held(snapshot, keys=None):
    return {r.key: bytes(r.data) for r in snapshot.objects(keys).collect()}


def test_readers_keep_their_version(spark, tmp_path):
    log, model, seen, pick = ObjectLog(spark, f"{tmp_path}/a"), {}, [], random.Random(4)
    assert held(log.open()) == {} and log.versions() == []
    for n in range(6):
        rows = {f"k{pick.randrange(9)}": f"{n}".encode() for _ in range(4)}
        if n % 3 == 2:
            log.delete(spark.createDataFrame([(k,) for k in [*rows, *rows]], "key string"))
            model = {k: v for k, v in model.items() if k not in rows}
        elif n % 3 == 1:
            rows = {k: v for k, v in rows.items() if k in model} or {next(iter(model)): b"x"}
            log.replace(objects(spark, rows))
            model = model | rows
        else:
            log.put(objects(spark, rows))
            model = model | rows
        seen.append((log.open(), dict(model)))
    for n, (snapshot, want) in enumerate(seen):
        assert snapshot.version == n + 1 and held(snapshot) == want == held(log.open(n + 1))
    key = next(iter(model))
    assert held(log.open(), [key, "none"]) == {key: model[key]} and held(log.open(), []) == {}
    assert log.compact() == 7 and held(log.open()) == model and len(log.open().parts) == 1 and held(seen[2][0]) == seen[2][1]


def test_one_of_two_commits_wins(spark, tmp_path):
    log = ObjectLog(spark, f"file://{tmp_path}/b")
    log.put(objects(spark, {"a": b"1", "m": b"list"}))
    base = log.open()
    assert log.put(objects(spark, {"b": b"2"}), base) == 2
    with pytest.raises(CatalogError, match="conflict"):
        log.delete(objects(spark, {"a": b""}), base)
    assert held(log.open()) == {"a": b"1", "b": b"2", "m": b"list"}
    other = log.clone(f"file://{tmp_path}/c")
    other.delete(objects(spark, {"a": b""}))
    log.replace(objects(spark, {"m": b"new"}))
    assert held(other.open()) == {"b": b"2", "m": b"list"} and held(log.open()) == {"a": b"1", "b": b"2", "m": b"new"}
    assert {r.key: r.role for r in log.open().objects().collect()} == {"a": "data", "b": "data", "m": "manifest"}


def test_bad_commits_show_nothing(spark, tmp_path):
    log = ObjectLog(spark, f"{tmp_path}/d")
    log.put(objects(spark, {"a": b"1"}))
    two = objects(spark, {"b": b"1"})
    for code, act in (("conflict", lambda: log.put(two.union(two))), ("reference", lambda: log.replace(two)), ("input", lambda: log.put(objects(spark, {None: b"1"}))), ("input", lambda: log.put(objects(spark, {"b": None}))), ("reference", lambda: log.open(9))):
        with pytest.raises(CatalogError) as e:
            act()
        assert e.value.code == code
    assert log.versions() == [1] and held(log.open()) == {"a": b"1"}


def test_keys_are_not_broadcast(spark, tmp_path):
    """Compressed keys look small to Spark, however many there are; the driver must not hold them."""
    log = ObjectLog(spark, f"{tmp_path}/h")
    log.put(objects(spark, {"a": b"1", "b": b"2"}))
    log.replace(objects(spark, {"b": b"3"}))
    log.delete(spark.createDataFrame([("a",)], "key string"))
    assert held(log.open()) == {"b": b"3"}
    plan = log.open().objects()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
