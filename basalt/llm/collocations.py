"""Phrase collocations from count streams in prefix and in suffix order.

* Words are counted, and those seen often enough get numbers; no phrase with a rarer word can be frequent.
* Windows of up to four such words are sorted by their first words. Occurrences of a
  phrase stand side by side in that order, so one pass over the stream counts the
  phrases of every length.
* The frequent phrases are kept as two streams, ordered by their first and by their last
  words. In the first the parts that begin a phrase come before it and its extensions
  to the right after it; in the other it is the parts that end it and extensions
  to the left. One pass over each gives those counts, and a merge join puts the streams together.

Phrases are four numbers of words in two 64-bit integers, so counts are exact and nothing is hashed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from basalt.llm import digests
from basalt.llm.numbering import numbered
from basalt.operators.validate import CatalogError
from basalt.plans.durable import written

#: Fixed value: where texts are cut into pieces.
MARKS = b".,;:!?\n\x0b\x0c\r"
LONGEST = 4
DISTINCT = 500_000  # words summed up before they leave a task
STEP = 400_000  # words numbered at once
HELD = 2_000_000  # windows summed up before they leave a task
KNOWN = 600_000  # numbers of words that a task remembers
SALTS = 64
HALF = np.int64(0xFFFFFFFF)
ROW, EXTENSION, LAST = 0, 1, 2

_low = bytes(range(256)).lower()
_spaced = bytes(32 if b in MARKS else _low[b] for b in range(256))
_dotted = bytes(46 if b in MARKS else _low[b] for b in range(256))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word binary, n) of (lang, text binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen.setdefault(lang, Counter()).update((text.as_py() or b"").translate(_spaced).split())
                if sum(map(len, seen.values())) >= DISTINCT:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def windows(texts: DataFrame, numbers: digests.DigestTable) -> DataFrame:
    """(hi, lo, n): four words from each place on, as far as they are frequent and in one piece; two of them at least.

    Each task sums up equal windows first, so one that all texts repeat stays few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        waiting: dict[str, list[bytes]] = {}
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def number() -> None:
            for lang, words in waiting.items():
                if sum(map(len, known.values())) > KNOWN:
                    known.clear()
                own = known.setdefault(lang, {b".": 0})
                new = list(set(words).difference(own))
                key = lang.encode() + b" "
                found = digests.look_up(numbers, [key + w for w in new])
                own.update(zip(new, np.maximum(found, 0).tolist()))
                w1 = np.fromiter(map(own.__getitem__, words), np.int64, len(words))
                w2, w3, w4 = (np.concatenate([w1[k:], np.zeros(min(k, len(w1)), np.int64)]) for k in (1, 2, 3))
                w3 = np.where(w2 > 0, w3, 0)
                w4 = np.where(w3 > 0, w4, 0)
                some = (w1 > 0) & (w2 > 0)
                parts.append(((w1 << 32 | w2)[some], (w3 << 32 | w4)[some]))
            waiting.clear()

        def out() -> Iterator[pa.RecordBatch]:
            if parts:
                hi, lo = (np.concatenate(x) for x in zip(*parts))
                parts.clear()
                order = np.lexsort((lo, hi))
                hi, lo = hi[order], lo[order]
                first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
                n = np.diff(np.append(first, len(hi)))
                for a in range(0, len(first), 100_000):
                    cut = first[a : a + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(hi[cut]), pa.array(lo[cut]), pa.array(n[a : a + 100_000])], ["hi", "lo", "n"])

        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = waiting.setdefault(lang, [])
                before = len(own)
                own += (text.as_py() or b"").translate(_dotted).replace(b".", b" . ").split()
                own.append(b".")
                size += len(own) - before
                if size >= STEP:
                    number()
                    size = 0
                    if sum(len(h) for h, _ in parts) >= HELD:
                        yield from out()
        number()
        yield from out()

    return texts.mapInArrow(run, "hi bigint, lo bigint, n bigint")


def _runs(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))


def _cut(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` words."""
    return (hi if k > 1 else hi & ~HALF), (lo if k > 3 else lo & ~HALF if k == 3 else lo & np.int64(0))


def _size(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return 1 + (hi & HALF > 0).astype(np.int64) + (lo > 0) + (lo & HALF > 0)


def phrase_counts(sorted_windows: DataFrame, least: int) -> DataFrame:
    """(hi, lo, n) of phrases of two and more words, from windows in prefix order within and across partitions.

    A phrase whose run touches an end of a partition may go on beyond it; its parts are summed up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        open_ = {k: (none, none, none) for k in range(2, LONGEST + 1)}
        first = dict.fromkeys(open_, True)
        for batch in batches:
            all_ = [batch.column(i).to_numpy() for i in range(3)]
            size = _size(all_[0], all_[1])
            for k in open_:
                hi, lo, n = (np.concatenate([a, b[size >= k]]) for a, b in zip(open_[k], all_))
                if not len(hi):
                    continue
                hi, lo = _cut(hi, lo, k)
                at = _runs(hi, lo)
                sums = np.add.reduceat(n, at)
                keep = sums[:-1] >= least
                if len(keep):
                    keep[0] |= first[k]
                    first[k] = False
                yield pa.RecordBatch.from_arrays([pa.array(hi[at[:-1]][keep]), pa.array(lo[at[:-1]][keep]), pa.array(sums[:-1][keep])], ["hi", "lo", "n"])
                open_[k] = (hi[at[-1:]], lo[at[-1:]], sums[-1:])
        for hi, lo, n in open_.values():
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo), pa.array(n)], ["hi", "lo", "n"])

    whole = sorted_windows.mapInArrow(run, "hi bigint, lo bigint, n bigint").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    return whole.where(F.col("n") >= least)


def _word(k: int) -> Column:
    at = F.shiftright("hi" if k < 2 else "lo", 32) if k % 2 == 0 else F.col("hi" if k < 2 else "lo").bitwiseAND(int(HALF))
    return at.cast("bigint")


def _length() -> Column:
    return sum(((_word(k) > 0).cast("int") for k in range(1, LONGEST)), F.lit(1))


def _turned(rows: DataFrame) -> DataFrame:
    """The words of (hi, lo) in the opposite order, the rest as it was."""
    w, size = [_word(k) for k in range(LONGEST)], _length()
    back = [F.when(size > k, F.element_at(F.array(*w), (size - k).cast("int"))).otherwise(F.lit(0).cast("bigint")) for k in range(LONGEST)]
    return rows.withColumns({"hi": F.shiftleft(back[0], 32).bitwiseOR(back[1]), "lo": F.shiftleft(back[2], 32).bitwiseOR(back[3])})


def stream(counts: DataFrame, name: str) -> DataFrame:
    """(hi, lo, n, part1, part2, part3, extension) of (hi, lo, n): counts of the first 1 to 3 words and the largest of phrases one word longer.

    ``counts`` holds every part of its phrases. In order of the words the last phrase of k
    words before a longer one is its own first part, so the pass holds one number for
    each k. What a partition's first rows need of earlier ones, three numbers a partition, is added afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = [-1, -1, -1]

        def out(kind: int, hi, lo, n, parts, extension) -> pa.RecordBatch:
            m = len(hi)
            known = [pa.array(x, pa.int64(), mask=x < 0) for x in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, kind, np.int32)), pa.array(hi), pa.array(lo), pa.array(n), *known, pa.array(extension)],
                ["part", "kind", "hi", "lo", "n", "part1", "part2", "part3", "extension"],
            )

        for batch in batches:
            hi, lo, n = (batch.column(i).to_numpy() for i in range(3))
            if not len(hi):
                continue
            size, parts, none = _size(hi, lo), [], np.zeros(len(hi), np.int64)
            for k in range(1, LONGEST):
                seen = np.maximum.accumulate(np.where(size == k, np.arange(len(hi)), -1))
                filled = np.where(seen >= 0, n[seen], last[k - 1])
                last[k - 1] = int(filled[-1])
                parts.append(np.where(size > k, filled, 0))
            yield out(ROW, hi, lo, n, parts, none)
            for k in range(2, LONGEST + 1):
                own = size == k
                if own.any():
                    h, l = _cut(hi[own], lo[own], k - 1)  # noqa: E741
                    at = _runs(h, l)
                    zero = np.zeros(len(at), np.int64)
                    yield out(EXTENSION, h[at], l[at], zero, [zero] * 3, np.maximum.reduceat(n[own], at))
        one = np.zeros(1, np.int64)
        yield out(LAST, one, one, one, [np.array([x]) for x in last], one)

    placed = counts.select("hi", "lo", "n").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    done = written(placed.mapInArrow(run, "part int, kind int, hi bigint, lo bigint, n bigint, part1 bigint, part2 bigint, part3 bigint, extension bigint"), name)
    before, known = [], (None, None, None)
    for r in sorted(done.where(F.col("kind") == LAST).select("part", "part1", "part2", "part3").collect()):  # one row a partition
        before.append((r[0], *known))
        known = tuple(a if a is not None else b for a, b in zip(r[1:], known))
    carried = done.sparkSession.createDataFrame(before, "part int, b1 bigint, b2 bigint, b3 bigint")
    rows = done.where(F.col("kind") != LAST).join(F.broadcast(carried), "part")
    parts = [F.max(F.coalesce(f"part{k}", f"b{k}")).alias(f"part{k}") for k in range(1, LONGEST)]
    return rows.groupBy("hi", "lo").agg(F.max("n").alias("n"), *parts, F.max("extension").alias("extension"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def best_cut() -> Column:
    """(score, k, l, r) of the cut with the lowest score, then the smallest k; sums and products in decimals."""
    size, cuts = _length(), []
    for k in range(1, LONGEST):
        l, r = F.col(f"part{k}"), F.lit(None).cast("bigint")  # noqa: E741
        for n in range(k + 1, LONGEST + 1):
            r = F.when(size == n, F.col(f"end{n - k}")).otherwise(r)
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * _wide(F.col("n")), _wide(l) + _wide(r))
        cuts.append(F.when(size > k, F.struct(score.alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))))
    return F.array_min(F.array_compact(F.array(*cuts)))


def collocations(docs: DataFrame, least: int = 30, covered: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 4 words.

    A phrase counts if it occurs ``least`` times, and unless a longer such phrase that holds it
    occurs at ``covered`` per cent of its places or more. A longer one implies
    such a phrase of one word more, so those alone are compared.

    Null and empty texts have no words; a null language is ``und``. Repeated rows count as often
    as they come. Ties are in order of the phrases' UTF-8 bytes. An empty table gives no
    rows, and other columns, ids too, are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    words = written(word_counts(texts), "words")
    frequent = written(numbered(words.where(F.col("n") >= least), [F.col("lang"), F.col("word")], "id"), "frequent")
    if frequent.count() >= 1 << 31:
        raise CatalogError("limit", "more than 2^31 frequent words")
    numbers = digests.build(frequent.select(F.concat(F.encode("lang", "UTF-8"), F.lit(b" "), F.col("word")).alias("key"), F.col("id").alias("value")), "word-numbers")
    # written, as sorting by ranges reads its input twice
    cut = written(windows(texts, numbers), "windows").repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo")
    single = frequent.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("bigint").alias("lo"), "n")
    counts = written(phrase_counts(cut, least).unionByName(single), "counts")

    left = stream(counts, "prefix-order").where(F.col("hi").bitwiseAND(int(HALF)) > 0)
    right = _turned(stream(_turned(counts), "suffix-order")).where(F.col("hi").bitwiseAND(int(HALF)) > 0)
    ends = right.select("hi", "lo", *(F.col(f"part{k}").alias(f"end{k}") for k in range(1, LONGEST)), F.col("extension").alias("to_left"))
    both = left.join(ends.hint("merge"), ["hi", "lo"])
    longer = F.greatest("extension", "to_left")
    kept = both.where(F.lit(100) * _wide(longer) < F.lit(covered) * _wide(F.col("n")))
    scored = kept.withColumn("cut", best_cut()).select("hi", "lo", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score", _word(0).alias("id"))
    scored = scored.join(frequent.select("id", "lang"), "id").drop("id")

    # first within salts, ties and all; then with the words of what is left
    salt = F.pmod(F.xxhash64("hi", "lo"), F.lit(SALTS))
    order = [F.desc("score"), F.desc("a")]
    fore = scored.withColumn("salt", salt).withColumn("at", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    fore = written(fore.where(F.col("at") <= top).drop("at"), "foremost")
    each = fore.select("hi", "lo", F.posexplode(F.array(*(_word(k) for k in range(LONGEST)))).alias("at", "id")).where("id > 0")
    each = each.join(frequent.select("id", F.decode("word", "UTF-8").alias("word")), "id")
    said = each.groupBy("hi", "lo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = fore.join(said, ["hi", "lo"])
    own = Window.partitionBy("lang", "salt").orderBy(*order, "phrase")
    whole = whole.withColumn("at", F.row_number().over(own)).where(F.col("at") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase"))  # of at most SALTS * top rows
    ranked = whole.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
