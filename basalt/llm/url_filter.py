"""URL filters: rules in a sorted digest array, probed with every host suffix and path prefix that a rule could be.

A rule is ``host/path``. It fits its host and all subdomains, if the url's path starts
with the rule's; of several the longest decides. URLs stay where they are: rules are
looked up by the worker, so a frequent host moves and gathers nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basalt.llm import digests
from basalt.plans.durable import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
PROBES = 200_000  # keys looked up at once


@dataclass(frozen=True)
class UrlRules:
    table: digests.DigestTable
    shapes: dict[int, list[int]]  # bytes of a rule's host -> bytes of the paths after it, longest first


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def compile_rules(rules: DataFrame, per_shard: int = digests.PER_SHARD) -> UrlRules:
    """Store rules (rule string, verdict 'allow' or 'block'); null ones count for nothing.

    Hosts are taken in lower case. A rule given with both verdicts blocks. The driver
    gathers only the distinct lengths of hosts and paths, which don't grow with the
    number of rules.
    """
    host = F.translate(F.regexp_extract("rule", "^[^/]*", 0), UPPER, LOWER)
    key = F.concat(host, F.regexp_extract("rule", r"/[\s\S]*", 0))
    known = rules.where(F.col("rule").isNotNull() & F.col("verdict").isin(*VERDICTS))
    known = known.select(F.encode(key, "UTF-8").alias("key"), F.octet_length(host).alias("host"), (F.col("verdict") == "block").cast("bigint").alias("value"))
    one = written(known.groupBy("key", "host").agg(F.max("value").alias("value")), "rules")
    shapes: dict[int, list[int]] = {}
    for r in one.select("host", (F.octet_length("key") - F.col("host")).alias("path")).distinct().collect():
        shapes.setdefault(r["host"], []).append(r["path"])
    return UrlRules(digests.build(one.select("key", "value"), "url-rules", per_shard), {h: sorted(p, reverse=True) for h, p in shapes.items()})


def candidates(host: bytes, path: bytes, shapes: dict[int, list[int]]) -> Iterator[tuple[int, bytes]]:
    """(order, rule) of all rules that could fit; of those that do, the highest order wins: the longest, then the longest host."""
    longest, dot = max(shapes, default=-1), len(host)
    while True:
        dot = host.rfind(b".", 0, dot)
        own = len(host) - dot - 1
        if own > longest:
            return
        for n in shapes.get(own, ()):
            if n <= len(path):
                yield (own + n << 32 | own), host[dot + 1 :] + path[:n]
        if dot < 0:
            return


def judge(pages: DataFrame, rules: UrlRules, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(``id_col``, host, path, rule, verdict) of every row.

    A null url and one without ``://`` have an empty host and path. Where no rule fits,
    ``rule`` is null and the verdict ``otherwise``. Repeated rows, null ids and texts of
    any length are judged like others, other columns are ignored, and an empty table or
    no rules at all are fine.
    """
    shapes, table = rules.shapes, rules.table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            best, told, value = np.full(n, -1, np.int64), [None] * n, np.zeros(n, np.int64)

            def probe(rows: list[int], orders: list[int], keys: list[bytes]) -> None:
                for r, o, k, v in zip(rows, orders, keys, digests.look_up(table, keys).tolist()):
                    if v >= 0 and o > best[r]:
                        best[r], told[r], value[r] = o, k.decode(), v

            rows, orders, keys = [], [], []
            for i, (host, path) in enumerate(zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())):
                for order, key in candidates(host, path, shapes):
                    rows.append(i)
                    orders.append(order)
                    keys.append(key)
                    if len(keys) >= PROBES:
                        probe(rows, orders, keys)
                        rows, orders, keys = [], [], []
            probe(rows, orders, keys)
            verdict = [otherwise if r is None else VERDICTS[v] for r, v in zip(told, value.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string()), pa.array(verdict, pa.string())], [*batch.schema.names, "rule", "verdict"])

    own = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
