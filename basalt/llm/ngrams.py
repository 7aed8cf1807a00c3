"""Interpolated modified Kneser-Ney scores from sorted hash arrays.

Spark counts the training words and pairs of words; the counts lie in the shared
folder as arrays sorted by key and cut into shards, which workers memory-map.

* vocabulary: 64-bit word hashes and counts, sharded by the leading bits; a word's
  id is its place among all sorted hashes.
* pairs: (id of the word before) << 32 | id, and counts, sharded by a hash of the
  key, so a frequent word is spread over all shards.
* by id, dense: how often and with how many words seen once, twice, more often
  a word goes before, and after how many different words it comes.

What crosses the network is summed up per task first, and packed.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from basalt.llm import caches
from basalt.llm.arrays import expand, load, save, squeeze
from basalt.llm.words import hashed, mixed, words
from basalt.plans.durable import scratch, written

END = xxhash.xxh3_64_intdigest(b" end of text ")  # no word holds a space
STEP = 1_000_000  # tokens handled at once
HELD = 4_000_000  # pairs summed up before they leave a task
DISTINCT = 1_000_000  # words summed up before they leave a task


@dataclass
class Model:
    root: str
    bits: int
    shards: int
    vocabulary: int
    tokens: int
    bases: dict[int, int] = field(default_factory=dict)
    pairs: int = 0
    high: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    low: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    rest: float = 1.0  # share of the uniform distribution at the lowest level
    pair_shards: frozenset[int] = frozenset()
    id_shards: frozenset[int] = frozenset()


def _steps(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the tokens of some documents, each closed by END, and where each begins."""
    parts, starts, n = [], [], 0
    end = np.array([END], np.uint64)
    for t in texts.cast(pa.binary()):
        h = hashed(words(t.as_py()))
        starts.append(n)
        parts += [h, end]
        n += len(h) + 1
        if n >= STEP:
            yield np.concatenate(parts), np.array(starts)
            parts, starts, n = [], [], 0
    if n:
        yield np.concatenate(parts), np.array(starts)


def _vocabulary(train: DataFrame, root: str, bits: int) -> list:
    """Count words and write the vocabulary's shards; (shard, words, tokens) of each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            hashes = np.concatenate([hashed(list(seen)), np.array([END] if ends else [], np.uint64)])
            sizes = np.fromiter([*seen.values(), *([ends] if ends else [])], np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sizes)], ["hash", "n"])

        ends = 0
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()):
                seen.update(words(t.as_py()))
                ends += 1
                if len(seen) >= DISTINCT:
                    yield out()
                    seen.clear()
                    ends = 0
        yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(list)
        for batch in batches:
            shard, h, n = (batch.column(i).to_numpy() for i in range(3))
            for s in np.unique(shard):
                by[int(s)].append((h[shard == s].view(np.uint64), n[shard == s]))
        for s, parts in sorted(by.items()):
            h, n = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h)
            save(root, f"words-{s}", h[order])
            save(root, f"counts-{s}", n[order])
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([len(h)], pa.int64()), pa.array([int(n.sum())], pa.int64())], ["shard", "words", "tokens"])

    counts = train.mapInArrow(count, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    shard = F.shiftrightunsigned(F.col("hash"), 64 - bits).cast("int") if bits else F.lit(0)
    cut = counts.select(shard.alias("shard"), "hash", "n").repartitionById(1 << bits, F.col("shard"))
    return cut.mapInArrow(write, "shard int, words bigint, tokens bigint").collect()


def look_up(model: Model, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of sorted distinct hashes; unknown ones have id vocabulary + 1 and count 0."""
    ids, counts = np.full(len(hashes), model.vocabulary + 1, np.uint64), np.zeros(len(hashes), np.int64)
    shard = (hashes >> np.uint64(64 - model.bits)).astype(np.int64) if model.bits else np.zeros(len(hashes), np.int64)
    edges = np.searchsorted(shard, np.arange((1 << model.bits) + 1))
    for s, base in model.bases.items():
        a, b = edges[s], edges[s + 1]
        if a < b:
            table = load(model.root, f"words-{s}")
            at = np.minimum(np.searchsorted(table, hashes[a:b]), len(table) - 1)
            hit = table[at] == hashes[a:b]
            ids[a:b][hit] = base + at[hit]
            counts[a:b][hit] = load(model.root, f"counts-{s}")[at[hit]]
    return ids, counts


def _id_shard(model: Model, ids: np.ndarray) -> np.ndarray:
    return (ids // np.uint64(model.vocabulary // model.shards + 1)).astype(np.int64)


def _pairs(train: DataFrame, model: Model) -> DataFrame:
    """Count pairs, write their shards; what each shard adds to the numbers by id, packed."""
    root, shards, first = model.root, model.shards, np.uint64(model.vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shard = (mixed(keys) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keys, counts, shard = keys[order], counts[order].astype("<u4"), shard[order]
            cuts = np.flatnonzero(np.diff(shard, prepend=-1))
            ends = [*cuts[1:], len(keys)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(shard[cuts].astype(np.int32)),
                    pa.array([squeeze(keys[a:b], ascending=True) for a, b in zip(cuts, ends)], pa.binary()),
                    pa.array([squeeze(counts[a:b]) for a, b in zip(cuts, ends)], pa.binary()),
                ],
                ["shard", "keys", "counts"],
            )

        for batch in batches:
            for h, starts in _steps(batch.column(0)):
                unique, inverse = np.unique(h, return_inverse=True)
                ids = look_up(model, unique)[0][inverse]
                before = np.concatenate([[first], ids[:-1]])
                before[starts] = first
                held.append(before << np.uint64(32) | ids)
                n += len(ids)
                if n >= HELD:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = defaultdict(list)
        for batch in batches:
            for s, k, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                by[s].append((k, c))
        for s, parts in sorted(by.items()):
            keys = np.concatenate([expand(k, ascending=True) for k, _ in parts])
            counts = np.concatenate([expand(c) for _, c in parts]).astype(np.int64)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, counts = keys[cuts], np.add.reduceat(counts, cuts)
            save(root, f"pairs-{s}", keys)
            save(root, f"pair-counts-{s}", counts.astype("<u4") if counts.max() < 2**32 else counts)
            before = keys >> np.uint64(32)
            cuts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
            sums = [np.add.reduceat(x.astype(np.int64), cuts) for x in (counts, counts == 1, counts == 2, counts >= 3)]
            after, kinds = np.unique(keys & np.uint64(2**32 - 1), return_counts=True)
            of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            for kind, ids, columns in ((0, before[cuts], sums), (1, after, [kinds])):
                target = _id_shard(model, ids)
                edges = np.flatnonzero(np.diff(target, prepend=-1))
                for a, b in zip(edges, [*edges[1:], len(ids)]):
                    row = [[int(target[a])], [kind], [squeeze(ids[a:b], ascending=True)], [[squeeze(x[a:b].astype("<u8")) for x in columns]], [s], [len(keys) if of else 0], [of]]
                    types = [pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], ["target", "kind", "ids", "columns", "shard", "pairs", "of"])
                    of = []

    counted = train.mapInArrow(count, "shard int, keys binary, counts binary").repartitionById(shards, F.col("shard"))
    return written(counted.mapInArrow(merge, "target int, kind int, ids binary, columns array<binary>, shard int, pairs bigint, of array<bigint>"), "pair-sums")


def _by_id(sums: DataFrame, model: Model) -> list:
    """Write the dense arrays by id; (target, how many words come after 1, 2, 3, 4 different ones)."""
    root, wide = model.root, model.vocabulary // model.shards + 1

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for batch in batches:
            for target, kind, ids, columns in zip(*(batch.column(i).to_pylist() for i in range(4))):
                dense = by.setdefault(target, np.zeros((wide, 5), np.int64))
                at = (expand(ids, ascending=True) - np.uint64(target * wide)).astype(np.int64)
                for j, c in enumerate(columns):
                    dense[at, 4 if kind else j] += expand(c).astype(np.int64)
        for target, dense in sorted(by.items()):
            save(root, f"ids-{target}", dense)
            of = [int((dense[:, 4] == k).sum()) for k in (1, 2, 3, 4)]
            of.append(int((dense[:, 4] > 2).sum()))
            yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([of], pa.list_(pa.int64()))], ["target", "of"])

    cut = sums.select("target", "kind", "ids", "columns").repartitionById(model.shards, F.col("target"))
    return cut.mapInArrow(write, "target int, of array<bigint>").collect()


def discounts(of: list[int]) -> tuple[float, float, float, float]:
    """The modified discounts for counts 0, 1, 2 and 3 or more, from the counts of counts."""
    n1, n2, n3, n4 = of[:4]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return (0.0, *(float(min(max(d, 0.05), k)) for k, d in enumerate(raw, 1)))


def train(docs: DataFrame, trained: Column, text_col: str = "text") -> Model:
    """Count the texts of the rows for which ``trained`` holds. Null text is empty."""
    spark = docs.sparkSession
    rows = docs.where(trained).select(F.col(text_col).alias("text"))
    bits = max(0, int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()  # a shard is what one task of a shuffle holds
    root = scratch(spark, "ngrams")
    parts = sorted((r["shard"], r["words"], r["tokens"]) for r in _vocabulary(rows, root, bits))
    model = Model(root, bits, 1 << bits, sum(p[1] for p in parts), sum(p[2] for p in parts))
    at = 0
    for s, n, _ in parts:
        model.bases[s] = at
        at += n
    if model.vocabulary >= 2**32 - 1:
        raise ValueError("ids of words have 32 bits: too many distinct words")
    if not model.tokens:
        return model
    sums = _pairs(rows, model)
    own = sums.where(F.size("of") > 0).select("shard", "pairs", "of").collect()  # one row a shard
    model.pairs = sum(r["pairs"] for r in own)
    model.pair_shards = frozenset(r["shard"] for r in own)
    model.high = discounts([sum(r["of"][k] for r in own) for k in range(4)])
    ids = _by_id(sums, model)
    model.id_shards = frozenset(r["target"] for r in ids)
    of = [sum(r["of"][k] for r in ids) for k in range(5)]
    model.low = discounts(of)
    model.rest = (model.low[1] * of[0] + model.low[2] * of[1] + model.low[3] * of[4]) / model.pairs
    return model


def _pair_counts(model: Model, keys: np.ndarray) -> np.ndarray:
    """Counts of sorted distinct keys."""
    out = np.zeros(len(keys), np.int64)
    shard = (mixed(keys) % np.uint64(model.shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(model.shards + 1))
    for s in model.pair_shards:
        mine = order[edges[s] : edges[s + 1]]
        if len(mine):
            table = load(model.root, f"pairs-{s}")
            at = np.minimum(np.searchsorted(table, keys[mine]), len(table) - 1)
            hit = table[at] == keys[mine]
            out[mine[hit]] = load(model.root, f"pair-counts-{s}")[at[hit]]
    return out


def _numbers(model: Model, ids: np.ndarray) -> np.ndarray:
    """The dense rows of ids; zeros for unknown words."""
    out = np.zeros((len(ids), 5), np.int64)
    target, wide = _id_shard(model, ids), model.vocabulary // model.shards + 1
    known = ids <= model.vocabulary
    for s in np.unique(target[known]):
        if int(s) in model.id_shards:
            mine = np.flatnonzero((target == s) & known)
            out[mine] = load(model.root, f"ids-{s}")[(ids[mine] - np.uint64(s * wide)).astype(np.int64)]
    return out


def log10_scores(model: Model, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per document: known tokens, add-one unigram log10, model log10."""
    unique, inverse = np.unique(h, return_inverse=True)
    ids, counts = look_up(model, unique)
    v, n = model.vocabulary, model.tokens
    known = np.add.reduceat((counts > 0)[inverse].astype(np.int64), starts)
    base = np.add.reduceat(np.log10((counts + 1) / (n + v + 1))[inverse], starts)
    if not n:
        return known, base, np.zeros(len(starts))
    first = np.array([v], np.uint64)
    rows = _numbers(model, np.concatenate([ids, first]))  # the last is the place before a text
    high, low = np.array(model.high), np.array(model.low)
    cont = rows[:-1, 4]
    p1 = (cont - low[np.minimum(cont, 3)]) / model.pairs + model.rest / (v + 1)
    total = rows[:, 0]
    gamma = np.where(total > 0, rows[:, 1:4] @ high[1:] / np.maximum(total, 1), 1.0)
    before = np.concatenate([[len(unique)], inverse[:-1]])
    before[starts] = len(unique)
    all_ids = np.concatenate([ids, first])
    keys, back = np.unique(all_ids[before] << np.uint64(32) | ids[inverse], return_inverse=True)
    c = _pair_counts(model, keys)
    above = (c - high[np.minimum(c, 3)])[back] / np.maximum(total, 1)[before]
    p = above + gamma[before] * p1[inverse]
    return known, base, np.add.reduceat(np.log10(p), starts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Every text has its words and one end token; null text is empty. With nothing to
    train on every probability is 1. Repeated rows and null ids are carried along;
    an empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few numbers a shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("words")
        model = held.value
        for batch in batches:
            got = [(np.diff(starts, append=len(h)), *log10_scores(model, h, starts)) for h, starts in _steps(batch.column(1))]
            if got:
                n, known, base, own = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(own)],
                    ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    )
