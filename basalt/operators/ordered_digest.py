"""SHA-256 over the ordered records of each group, in memory that doesn't grow with a group.

Spark sorts the rows by group and order, spilling as it needs to; a worker then feeds one
digest across Arrow batches. The digest of a group covers all its rows in order, so it
is one sequential stream by definition: a large group takes its time, not its memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F


#: Bytes from which on a piece of joined bodies is full: small, as a worker holds a batch of them.
PIECE = 1 << 14


def _starts(keys: list[pa.Array]) -> list[int]:
    """Where a row's keys differ from those of the row before; null equals null."""
    m = len(keys[0])
    new = np.ones(m, bool)
    if m > 1:
        same = np.ones(m - 1, bool)
        for c in keys:
            a, b = c.slice(1), c.slice(0, m - 1)
            equal = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
            same &= equal.to_numpy(zero_copy_only=False)
        new[1:] = ~same
    return np.flatnonzero(new).tolist()


def ordered_digest(rows: DataFrame, group: list[str], order: list[Column], body: Column, sums: dict[str, Column] | None = None, records: str = "records", name: str = "fingerprint") -> DataFrame:
    """(``group``, ``sums``, ``records``, ``name``): the digest of the canonical array of a group's bodies.

    Bodies come in ``order``, then in order of themselves; null ones are left out of the
    digest and counted. ``sums`` are bigints summed up on the way, null ones as 0. A null group is a group
    of its own. One shuffle, by the group.
    """
    sums = sums or {}
    summed = list(sums)
    keyed = rows.select(F.struct(*group).alias("g"), *(c.alias(f"o{i}") for i, c in enumerate(order)), body.alias("body"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(f"s{i}") for i, c in enumerate(sums.values())))
    keys = [f"o{i}" for i in range(len(order))]
    dealt = keyed.repartition("g").sortWithinPartitions("g", *keys, "body")
    own = dealt.select("g.*", F.encode("body", "UTF-8").alias("body"), *(f"s{i}" for i in range(len(sums))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n, totals, first, kinds = None, None, 0, [], True, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [*group, *summed, records, name])

        def close() -> None:
            digest.update(b"]")
            done.append((*key, *totals, n, digest.hexdigest()))

        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            kinds = [*(batch.column(i).type for i in range(len(group))), *[pa.int64()] * (len(summed) + 1), pa.string()]
            values = [batch.column(len(group) + 1 + i).to_numpy() for i in range(len(summed))]
            starts = _starts([batch.column(i) for i in range(len(group))])
            for a, b in zip(starts, [*starts[1:], m]):
                own = tuple(batch.column(i)[a].as_py() for i in range(len(group)))
                if digest is None or a or own != key:
                    if digest is not None:
                        close()
                    key, digest, n, totals, first = own, hashlib.sha256(b"["), 0, [0] * len(summed), True
                texts = [t for t in batch.column(len(group)).slice(a, b - a).to_pylist() if t is not None]
                if texts:
                    digest.update((b"" if first else b",") + b",".join(texts))
                    first = False
                n += b - a
                totals = [t + int(v[a:b].sum()) for t, v in zip(totals, values)]
            if done:
                yield out()
        if digest is not None:
            close()
            yield out()

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(group)]]
    kinds += [f"`{c}` bigint" for c in [*sums, records]] + [f"`{name}` string"]
    return own.mapInArrow(run, ", ".join(kinds))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n, data): bodies in a row joined to pieces, with the place of the first; ``data`` is null where all of them are."""
    at, n, held, size, done = None, 0, [], 0, []

    def out() -> pa.RecordBatch:
        columns = list(zip(*done))
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], ["at", "n", "data"])

    for batch in batches:
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at = place if n == 0 else at
            n += 1
            if text is not None:
                held.append(text)
                size += len(text) + 1
            if size >= PIECE:
                done.append((at, n, b",".join(held)))
                n, held, size = 0, [], 0
        if done:
            yield out()
    if n:
        done.append((at, n, b",".join(held) if held else None))
        yield out()


def whole_digest(rows: DataFrame, order: list[Column], body: Column, records: str = "records", name: str = "fingerprint") -> DataFrame:
    """(``records``, ``name``): the digest of ``ordered_digest`` over all rows as one group; no row if there are none.

    Ranges of the order are sorted side by side and each joins its bodies to pieces. The one
    task that feeds the digest puts pieces in order, not rows, and sees neither keys nor orders.
    """
    keys = [f"o{i}" for i in range(len(order))]
    keyed = rows.select(*(c.alias(k) for k, c in zip(keys, order)), body.alias("body"))
    placed = keyed.repartitionByRange(*keys, "body").sortWithinPartitions(*keys, "body")
    pieces = placed.select(F.monotonically_increasing_id().alias("at"), F.encode("body", "UTF-8").alias("body")).mapInArrow(_pieces, "at bigint, n bigint, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, n, first = hashlib.sha256(b"["), 0, True
        for batch in batches:
            n += sum(batch.column(0).to_pylist())
            for piece in batch.column(1):
                if piece.is_valid:
                    digest.update(piece.as_py() if first else b"," + piece.as_py())
                    first = False
        if n:
            digest.update(b"]")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([digest.hexdigest()], pa.string())], [records, name])

    return pieces.repartition(1).sortWithinPartitions("at").select("n", "data").mapInArrow(run, f"`{records}` bigint, `{name}` string")
