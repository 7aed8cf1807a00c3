"""Importance resampling towards a target corpus: hashed word features, gains by bucket, a seeded draw.

Words come from the tokenizers library's untrained pre-tokenisation, with their offsets.
A run of words is a window over consecutive offset pairs, and its feature the CRC-32 of
the words joined by one space, which is carried on from word to word. Texts are
cut into words once: each document's buckets are written, two bytes a feature, then
counted, and read again for its gains.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from basalt.llm.numbering import numbered
from basalt.plans.durable import written

#: Fixed value: what lies between words, after A-Z were lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_between = re.compile(BETWEEN.encode())
PIECE = 1 << 20  # bytes of a text that go through the library at once


class Words:
    """Words of UTF-8 texts, cut by the library."""

    def __init__(self) -> None:
        from tokenizers import PreTokenizedString, Regex
        from tokenizers.pre_tokenizers import Split

        self.held, self.split = PreTokenizedString, Split(Regex(BETWEEN), "removed")

    def of(self, text: bytes) -> list[bytes]:
        """Lower-cased words in order, cut out by their offsets."""
        low, out, at = text.lower(), [], 0
        while at < len(low):
            end = at + PIECE
            if end < len(low):  # go on to the end of a word; what lies between words is ASCII
                gap = _between.search(low, end)
                end = gap.start() if gap else len(low)
            piece = low[at:end]
            held = self.held(piece.decode("utf-8"))
            self.split.pre_tokenize(held)
            out += [piece[b:e] for _, (b, e), _ in held.get_splits("original", "byte")]
            at = end
        return out


def feature_buckets(words: list[bytes], longest: int, buckets: int) -> np.ndarray:
    """Buckets of all runs of 1 to ``longest`` words; a longer run's CRC goes on from that of the run without its last word."""
    spaced = [b" " + w for w in words]
    runs = [list(map(crc32, words))]
    for k in range(1, min(longest, len(words))):
        runs.append(list(map(crc32, spaced[k:], runs[-1][: len(words) - k])))
    n = sum(map(len, runs))
    return np.fromiter(itertools.chain.from_iterable(runs), np.uint32, n) % np.uint32(buckets)


def featurize(texts: DataFrame, text_col: str, keep: list[Column], longest: int, buckets: int) -> DataFrame:
    """(``keep``, words, buckets): the bucket of each feature as little-endian unsigned integers."""
    if buckets > 1 << 16:
        raise ValueError("at most 65,536 buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Words()
        for batch in batches:
            sizes, data = [], []
            for t in batch.column(0):
                words = cut.of(t.as_py() or b"")
                sizes.append(len(words))
                data.append(feature_buckets(words, longest, buckets).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], [*batch.schema.names[1:], "words", "buckets"])

    own = texts.select(F.encode(F.col(text_col), "UTF-8").alias("text"), *keep)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[1:])
    return own.mapInArrow(run, f"{kinds}words bigint, buckets binary")


def bucket_counts(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of all features; each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                n += np.bincount(np.frombuffer(b.as_py(), "<u2"), minlength=buckets)
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(n[hit])], ["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat; ``buckets`` numbers, whatever was counted."""
    n = {}
    for side, counts in (("s", source), ("t", target)):
        n[side] = np.zeros(buckets, np.int64)
        for r in counts.collect():
            n[side][r["bucket"]] = r["n"]
    s, t = n["s"].astype(np.float64), n["t"].astype(np.float64)
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(features: DataFrame, by_bucket: np.ndarray, keep: list[str]) -> DataFrame:
    """(``keep``, words, n_features, weight): the floored mean of the gains of all features, 0 without any."""
    table = features.sparkSession.sparkContext.broadcast(by_bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, weights = [], []
            for b in batch.column(batch.num_columns - 1):
                own = np.frombuffer(b.as_py(), "<u2")
                sizes.append(len(own))
                weights.append(int(table.value[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], [*batch.schema.names[:-1], "n_features", "weight"])

    own = features.select(*keep, "words", "buckets")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema.fields[:-1])
    return own.mapInArrow(run, f"{kinds}n_features bigint, weight bigint")


def noise(id_: Column, seed: int) -> Column:
    """A Gumbel deviate in thousandths, by a hash of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """(``id_col``, n_features, weight, score, rank) of every row of ``docs``.

    Of the documents with at least ``least`` words, ``percent`` in a hundred are drawn,
    by score, ties to the smaller id; their ranks are 1, 2, 3, ..., others' null.
    Null and empty texts have no features, a weight of 0 and are never drawn. Null ids
    come last among ties and share the noise of an empty id. Repeated rows are documents
    of their own, with equal scores and different ranks. An empty table gives no rows, an empty target
    the same gain to all; other columns are ignored.
    """
    own = written(featurize(docs, text_col, [F.col(id_col).alias("doc_id")], longest, buckets), "features")
    aim = featurize(target, target_col, [], longest, buckets)
    by_bucket = gains(bucket_counts(own, buckets), bucket_counts(aim, buckets), buckets)
    score = (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = written(weigh(own, by_bucket, ["doc_id"]).select("doc_id", "words", "n_features", "weight", score), "weights")
    fit = F.col("words") >= least
    drawn = scored.where(fit).count() * percent // 100
    ranked = numbered(scored.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    out = ranked.withColumn("rank", rank).unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("doc_id").alias(id_col), "n_features", "weight", "score", "rank")
