"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model crosses from a character to a following white space
marker, and none holds a line break, so merges never cross those places. Texts
are cut there. Spark gathers the distinct chunks of the whole table; each is
segmented once, and chunk hashes, ids and where they end lie in the shared folder
as arrays sorted by hash and cut into shards. Workers memory-map these and join
the ids back by position. Models without these properties, or with a normalizer
that changes text, are encoded text by text.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from basalt.llm import caches
from basalt.llm.arrays import load, save
from basalt.plans.durable import scratch

DISTINCT = 200_000  # chunks gathered before they leave a task
STEP = 1_000_000  # characters encoded at once
CACHED_CHUNKS = 500_000
CACHED_LENGTH = 64
MARK = "▁"
CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")
PROBE = "Ａﬁ  é \t x "

_loaded: dict[str, "Chunks"] = {}
caches.register("pieces", _loaded.clear)


@dataclass(frozen=True)
class Table:
    """Where the segmented chunks lie: 2^bits shards, of which ``shards`` hold any."""

    root: str
    bits: int
    shards: frozenset[int]

    def find(self, chunks: list[str]) -> dict[str, tuple[bytes, str | None]]:
        """Ids of chunks, and what they decode to if that is something else; without those that share a hash."""
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(c.encode()) for c in chunks), np.uint64, len(chunks))
        order = np.argsort(hashes)
        hashes = hashes[order]
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        edges = np.searchsorted(shard, np.arange((1 << self.bits) + 1))
        out = {}
        for s in np.unique(shard):
            if int(s) not in self.shards:
                continue
            mine = slice(edges[s], edges[s + 1])
            keys, ends, odd = (load(self.root, f"{name}-{s}") for name in ("chunks", "ends", "odd"))
            at = np.searchsorted(keys, hashes[mine])
            last = len(keys) - 1
            sole = (at <= last) & (keys[np.minimum(at, last)] == hashes[mine]) & ((at >= last) | (keys[np.minimum(at + 1, last)] != hashes[mine]))
            at, names = at[sole], order[mine][sole]
            place = np.searchsorted(odd, at)
            said = json.loads(load(self.root, f"said-{s}").tobytes()) if len(odd) else []
            ids = memoryview(load(self.root, f"ids-{s}")).cast("B")
            for k, a, b, i, row in zip(names.tolist(), np.where(at > 0, ends[at - 1], 0).tolist(), ends[at].tolist(), place.tolist(), at.tolist()):
                out[chunks[k]] = bytes(ids[4 * a : 4 * b]), said[i] if i < len(said) and odd[i] == row else None
        return out


def packed(ids: list[int]) -> bytes:
    """Little-endian signed 32-bit integers."""
    out = array("i", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Chunks:
    """The ids of each distinct chunk, as little-endian signed 32-bit integers.

    A chunk is a run of spaces or one line break, and what follows up to the next
    of either. ``odd`` holds chunks that don't decode to themselves. Chunks come
    from the table; chunks that aren't in it are segmented here.
    """

    def __init__(self, path: str, table: Table | None = None):
        from sentencepiece import SentencePieceProcessor

        self.model = m = SentencePieceProcessor(model_file=path)
        self.table = table
        self.known: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        plain = m.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
        self.cuts = plain and not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.mark = m.piece_to_id(MARK)
        self.letter = m.piece_to_id("a")

    def segment(self, chunks: list[str]) -> dict[str, tuple[bytes, str | None]]:
        """The model's ids of chunks, and what they decode to if that isn't the chunk."""
        # the library puts one marker before a text; it stands alone before a line break
        ids = self.model.encode([c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
        ids = [[self.mark] if c == " " else i if c[0] == " " else i[1:] for c, i in zip(chunks, ids)]
        said = self.model.decode([[self.letter, *i] for i in ids], num_threads=1)
        return {c: (packed(i), None if d[1:] == c else d[1:]) for c, i, d in zip(chunks, ids, said)}

    def cut(self, text: str) -> list[str]:
        return CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text, as the library's ``encode`` and ``decode`` give them."""
        if not self.cuts:
            ids = self.model.encode(texts, num_threads=1)
            return [(packed(i), d) for i, d in zip(ids, self.model.decode(ids, num_threads=1))] if texts else []
        if len(self.known) >= CACHED_CHUNKS:
            self.known.clear()
            self.odd.clear()
        cut = [self.cut(t) for t in texts]
        new = [c for c in set().union(*cut) if c not in self.known]
        found = self.table.find(new) if self.table else {}
        if len(found) < len(new):
            found |= self.segment([c for c in new if c not in found])
        for c, (ids, said) in found.items():
            self.known[c] = ids
            if said is not None:
                self.odd[c] = said
        out = []
        for cs in cut:
            said = "".join([self.odd.get(c, c) for c in cs]) if self.odd else "".join(cs)
            out.append((b"".join(map(self.known.__getitem__, cs)), said[1:]))
        for c in new:
            if len(c) > CACHED_LENGTH:
                del self.known[c]
                self.odd.pop(c, None)
        return out


def steps(texts: list[str | None]) -> Iterator[list[str]]:
    """Runs of texts, of about STEP characters; null is empty."""
    held, n = [], 0
    for t in texts:
        held.append(t or "")
        n += len(held[-1])
        if n >= STEP:
            yield held
            held, n = [], 0
    if held:
        yield held


def chunks(path: str, table: Table | None = None) -> Chunks:
    """This worker's chunks of a model; those of another table go first."""
    if path not in _loaded or _loaded[path].table != table:
        _loaded[path] = Chunks(path, table)
    return _loaded[path]


def segmented(docs: DataFrame, model: str, text_col: str = "text") -> Table:
    """Segment each distinct chunk of all texts once, and write the table."""
    spark = docs.sparkSession
    root, bits = scratch(spark, "chunks"), max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("pieces")
        own, seen = chunks(model), set()

        def out() -> pa.RecordBatch:
            data = [c.encode() for c in seen]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, data), np.uint64, len(data))
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(data, pa.binary())], ["hash", "chunk"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(own.cut(text or ""))
                if len(seen) >= DISTINCT:
                    yield out()
                    seen.clear()
        yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("pieces")
        own, by = chunks(model), {}
        for batch in batches:
            found = batch.column(2).cast(pa.string()).to_pylist()
            done = own.segment(found)
            for s, h, c in zip(batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist(), found):
                by.setdefault(s, []).append((h, *done[c]))
        for s, rows in sorted(by.items()):
            rows.sort(key=lambda r: r[0])
            odd = [(k, r[2]) for k, r in enumerate(rows) if r[2] is not None]
            save(root, f"chunks-{s}", np.array([r[0] for r in rows], np.uint64))
            save(root, f"ends-{s}", np.cumsum([len(r[1]) // 4 for r in rows]))
            save(root, f"ids-{s}", np.frombuffer(b"".join(r[1] for r in rows), "<i4"))
            save(root, f"odd-{s}", np.array([k for k, _ in odd], np.int64))
            save(root, f"said-{s}", np.frombuffer(json.dumps([x for _, x in odd]).encode(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array(sorted(by), pa.int32())], ["shard"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(gather, "hash bigint, chunk binary").distinct()
    shard = F.shiftrightunsigned(F.col("hash"), 64 - bits).cast("int") if bits else F.lit(0)
    cut = found.select(shard.alias("shard"), "hash", "chunk").repartitionById(1 << bits, F.col("shard"))
    return Table(root, bits, frozenset(r["shard"] for r in cut.mapInArrow(write, "shard int").collect()))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids array<int>, decoded string.

    Null text is empty and has no ids. Repeated rows and null identifiers are
    carried along; an empty table gives no rows; other columns are ignored.
    """
    table = segmented(docs, model, text_col) if Chunks(model).cuts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("pieces")
        own = chunks(model, table)
        for batch in batches:
            both = [done for texts in steps(batch.column(1).to_pylist()) for done in own.encode(texts)]
            sizes = np.fromiter((len(i) // 4 for i, _ in both), np.int64, len(both))
            ids = pa.array(np.frombuffer(b"".join(i for i, _ in both), "<i4"))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids), pa.array([d for _, d in both], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
