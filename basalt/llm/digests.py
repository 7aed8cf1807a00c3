"""Sorted digest arrays: look-up of strings by their 64-bit hashes, confirmed on the strings themselves.

A table of distinct keys lies in the shared folder as shards by the leading bits of the
keys' xxHash64: sorted hashes, the place and bytes of each full key, and a number for
each. Workers memory-map what they probe. Shards hold about ``PER_SHARD`` keys however
many there are, so each is written by one task in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basalt.llm.arrays import load, save
from basalt.plans.durable import scratch

PER_SHARD = 1 << 20
SEED = 42  # the one of Spark's own xxhash64


@dataclass(frozen=True)
class DigestTable:
    root: str
    bits: int
    shards: frozenset[int]  # those that hold keys


def build(keys: DataFrame, name: str, per_shard: int = PER_SHARD) -> DigestTable:
    """Store ``keys`` (key binary, value bigint), whose keys are distinct and not null.

    ``keys`` is read twice, so it should be a written table.
    """
    root = scratch(keys.sparkSession, name)
    bits = max(0, (max(1, keys.count()) - 1) // per_shard).bit_length()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one shard a partition, some PER_SHARD keys
        parts = [b for b in batches if b.num_rows]
        if parts:
            all_ = pa.Table.from_batches(parts)
            shard = all_.column(0)[0].as_py()
            hashes = all_.column(1).to_numpy().view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            sorted_keys = [all_.column(2)[i].as_py() for i in order.tolist()]
            ends = np.cumsum(np.fromiter(map(len, sorted_keys), np.int64, len(sorted_keys)))
            save(root, f"hashes-{shard}", hashes[order])
            save(root, f"places-{shard}", np.concatenate([np.zeros(1, np.int64), ends]))
            save(root, f"bytes-{shard}", np.frombuffer(b"".join(sorted_keys), np.uint8))
            save(root, f"values-{shard}", all_.column(3).to_numpy()[order])
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32())], ["shard"])

    hash_ = F.xxhash64("key")
    shard = F.shiftrightunsigned(hash_, 64 - bits).cast("int") if bits else F.lit(0)
    cut = keys.select(shard.alias("shard"), hash_.alias("hash"), "key", "value").repartitionById(1 << bits, F.col("shard"))
    return DigestTable(root, bits, frozenset(r["shard"] for r in cut.mapInArrow(write, "shard int").collect()))


def look_up(table: DigestTable, keys: list[bytes]) -> np.ndarray:
    """The number of each key, -1 for those that the table doesn't hold."""
    out = np.full(len(keys), -1, np.int64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
    order = np.argsort(hashes, kind="stable")
    shard = (hashes[order] >> np.uint64(64 - table.bits)).astype(np.int64) if table.bits else np.zeros(len(keys), np.int64)
    for s in np.unique(shard).tolist():
        if s not in table.shards:
            continue
        stored, places, text, values = (load(table.root, f"{n}-{s}") for n in ("hashes", "places", "bytes", "values"))
        own = order[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]
        at = np.searchsorted(stored, hashes[own])
        # equal hashes stand side by side: go on until the strings agree or the hash ends
        while len(own):
            near = at < len(stored)
            own, at = own[near], at[near]
            same = stored[at] == hashes[own]
            own, at = own[same], at[same]
            begin, end = places[at], places[at + 1]
            right = np.fromiter((text[b:e].tobytes() == keys[i] for i, b, e in zip(own.tolist(), begin.tolist(), end.tolist())), bool, len(own))
            out[own[right]] = values[at[right]]
            own, at = own[~right], at[~right] + 1
    return out
