"""Near-duplicates of documents by HyperMinHash.

A sketch has B buckets; each keeps, of its smallest shingle hash, the count of
leading zeros and a few mantissa bits: 6 + 10 bits instead of 64. Bands of
registers are hashed and documents that share a band are candidates. Of each band
only links to its smallest member (its hub) are tried at first, so a band of n
copies gives n - 1 pairs. What a band still holds in different components after
that is tried in full. Before any link is confirmed on the full shingle sets, sizes
and the Jaccard estimate, corrected for accidental register collisions, must allow
it. A document that many pairs name is cut into blocks of its partners, and its
sketch and text go once to each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from basalt.llm import caches
from basalt.llm.components import connected_components, unaligned
from basalt.llm.words import mixed, shingle_set
from basalt.plans.durable import checkpoint, forget, tidy, written

BANDS, ROWS = 48, 8  # at a similarity of 0.85, a pair shares no band with probability 3e-7
MANTISSA = 10
SIGMAS = 6.0
BLOCK = 64  # partners that share one copy of a document


def registers(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """One 16-bit register per bucket; 0 is empty. ``shingles`` are sorted and distinct.

    The bucket is the hash's place among B equal ranges, so buckets lie in order and
    the first hash of each is its smallest.
    """
    out = np.zeros(buckets, np.uint16)
    if len(shingles):
        wide = (shingles >> np.uint64(32)) * np.uint64(buckets)
        bucket = (wide >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        # what is left below the bucket: 32 bits of the range's fraction, then the hash's low half
        rest = ((wide[first] & np.uint64(0xFFFFFFFF)) << np.uint64(20)) | (shingles[first] & np.uint64(0xFFFFF))
        bits = (rest + np.uint64(1)).astype(np.float64).view(np.uint64)
        # exponent (52 less the leading zeros) and the leading mantissa bits, as a positive number
        out[bucket[first]] = ((bits >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA) + np.uint64(1)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """Hashes of the bands of one sketch that are not all empty."""
    parts = regs.reshape(BANDS, ROWS).view(np.uint64).reshape(BANDS, -1)
    out = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    for j in range(parts.shape[1]):
        out = mixed(out ^ parts[:, j]) + np.uint64(0x9E3779B97F4A7C15)
    return out[parts.any(axis=1)]


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Jaccard estimate of two sketches of sets of sizes n and m, and the registers it rests on.

    Two different minima fall into one register with probability c * nm / (n + m)^2
    where c = 2^-mantissa / (2 ln 2), the mean width of a register over its value.
    """
    used = int(np.count_nonzero(a | b))
    both = int(np.count_nonzero((a != 0) & (b != 0)))
    same = int(np.count_nonzero((a == b) & (a != 0)))
    accident = both * 2.0**-MANTISSA / (2 * np.log(2)) * n * m / (n + m) ** 2
    return (same - accident) / max(used - accident, 1e-9), used


def overlap_bounds(est: float, used: int, n: int, m: int) -> tuple[int, int]:
    """Least and largest intersection of sets of sizes n and m that the estimate allows, SIGMAS standard errors wide."""
    least, most = 0.0, 1.0
    if used:
        p, z = min(max(est, 0.0), 1.0), SIGMAS**2 / used  # Wilson's interval
        centre, half = (p + z / 2) / (1 + z), np.sqrt(z * p * (1 - p) + z * z / 4) / (1 + z)
        least, most = max(centre - half, 0.0), min(centre + half, 1.0)
    small = min(n, m)
    return min(int(least / (1 + least) * (n + m)), small), min(int(np.ceil(most / (1 + most) * (n + m))), small)


def _sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(row, doc_id, thash, n, set_hash, regs) of every document, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("words")
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n, sets, regs = [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingle_set(t, size)
                n.append(len(s))
                sets.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(registers(s, BANDS * ROWS).tobytes())
            rows = np.arange(row, row + len(n))
            row += len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())],
                ["row", "doc_id", "thash", "n", "set_hash", "regs"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("thash"))
    return written(own.mapInArrow(run, f"row bigint, doc_id {kind}, thash bigint, n bigint, set_hash binary, regs binary"), "sketches")


def _bands(reps: DataFrame) -> DataFrame:
    """(key, rep, n) for each band of each representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [band_keys(np.frombuffer(r, np.uint16)) for r in batch.column(2).to_pylist()]
            if keys:
                times = [len(k) for k in keys]
                rep, n = (pa.array(np.repeat(batch.column(i).to_numpy(), times)) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), rep, n], ["key", "rep", "n"])

    return reps.select("rep", "n", "regs").mapInArrow(run, "key bigint, rep bigint, n bigint")


def _measured(pairs: DataFrame, payload: DataFrame, percent: int, size: int, exact: bool = True) -> DataFrame:
    """(a, b, lo, hi, all) of pairs (a, b): bounds of the intersection, and the union's size where it was counted.

    The estimate comes first; only pairs that it allows are counted on full sets, and
    then lo = hi. Without ``exact`` nothing is counted, and pairs not allowed are left out.
    ``payload`` is (rep, n, regs, text). Each block of partners of ``a`` is a run of rows
    that begins with ``a`` itself, so a task holds one document and one batch.
    """
    cols = ["n", "regs", "text"] if exact else ["n", "regs"]
    held = unaligned(pairs.groupBy("a").agg(F.count("*").alias("members")), "a")
    blocks = checkpoint(pairs.join(held, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / BLOCK)).alias("block")))
    side = lambda df, by, b: df.join(payload, F.col(by) == F.col("rep")).select("a", "block", b.alias("b"), *cols)
    members = side(blocks, "b", F.col("b"))
    heads = side(blocks.select("a", "block").distinct(), "a", F.lit(None).cast("bigint"))
    dealt = members.union(heads).repartition("a", "block").sortWithinPartitions("a", "block", F.asc_nulls_first("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches.use("words")
        head_regs = head_n = head_text = head_set = None
        for batch in batches:
            out = []
            texts = batch.column(5).cast(pa.binary()) if exact else None
            for i, (a, b, n, regs) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)))):
                regs = np.frombuffer(regs, np.uint16)
                if b is None:
                    head_regs, head_n, head_set = regs, n, None
                    head_text = texts[i].as_py() if exact else None
                    continue
                lo, hi = overlap_bounds(*estimate(head_regs, regs, head_n, n), head_n, n)
                union = None
                if 100 * hi >= percent * (head_n + n - hi):
                    if exact:
                        if head_set is None:
                            head_set = shingle_set(head_text, size)
                        s = shingle_set(texts[i].as_py(), size)
                        at = np.minimum(np.searchsorted(head_set, s), len(head_set) - 1)
                        lo = hi = int(np.count_nonzero(head_set[at] == s))
                        union = head_n + n - lo
                elif not exact:
                    continue
                out.append((a, b, lo, hi, union))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 5, ["a", "b", "lo", "hi", "all"])

    return checkpoint(dealt.mapInArrow(run, "a bigint, b bigint, lo bigint, hi bigint, all bigint"))


def _lone(texts: DataFrame, size: int) -> DataFrame:
    """(rep, lone): how many shingles of each text no other one of ``texts`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                s = shingle_set(t.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), rep))], ["shingle", "rep"])

    held = texts.select("rep", "text").mapInArrow(run, "shingle bigint, rep bigint")
    once = held.groupBy("shingle").agg(F.count("*").alias("times"), F.min("rep").alias("rep")).where("times = 1")
    return once.groupBy("rep").agg(F.count("*").alias("lone"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (xxhash64).

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of
    ``size``-word shingles; a document with fewer words is one shingle, one without
    words (null, empty, blank) links with nothing. ``component_id`` is the smallest
    doc_id reachable, ``kept`` says that it is the document's own. Repeated rows and
    equal sets share a component; a null id counts only where nothing else is
    reached, and then stays. An empty table gives no rows; other columns are ignored.
    """
    sk = _sketches(docs, id_col, text_col, size)
    groups = sk.where("n > 0").groupBy("set_hash").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    groups = checkpoint(groups)
    reps = sk.join(groups.select("rep"), F.col("row") == F.col("rep")).select("rep", "n", "doc_id", "thash", "regs")
    reps = written(reps, "representatives")
    bands = _bands(reps)
    # a band holds every distinct member of a group that agrees in it, so what joins by band can be split like joins by hub
    held = bands.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    met = written(bands.join(unaligned(held, "key"), "key"), "bands")
    # a band's hub is the member whose bands hold most rows: near the centre of its group
    central = checkpoint(met.groupBy("rep").agg(F.sum("held").alias("central")))
    ranked = met.select("key", "rep", "n").join(central, "rep")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("central", (-F.col("rep")).alias("less"), "n")).alias("top"))
    hubs = unaligned(hubs.select("key", (-F.col("top.less")).alias("hub"), F.col("top.n").alias("hub_n")), "key")
    shared = written(met.join(hubs, "key").where("rep <> hub").select("key", "rep", "n", "hub", "hub_n"), "hubs")
    forget(met)
    tidy(docs.sparkSession)
    wanted = reps.join(central.select("rep"), "rep").select("rep", "n", "regs", F.xxhash64("doc_id").alias("idh"), "thash")
    texts = docs.select(F.xxhash64(id_col).alias("idh"), F.xxhash64(text_col).alias("thash"), F.col(text_col).alias("text"))
    # repeated rows meet in the join, whose order the aggregate can use
    payload = texts.join(wanted, ["idh", "thash"]).dropDuplicates(["idh", "thash"]).select("rep", "n", "regs", "text")
    payload = written(payload, "payload")
    forget(reps)
    tidy(docs.sparkSession)
    enough = lambda inter, union: (100 * inter) >= (percent * union)
    links = lambda tried: tried.where(enough(F.col("hi"), F.col("all")))
    stars = lambda c: c.select(F.col("id").alias("a"), F.col("component").alias("b"))
    grown = lambda c, found: connected_components(stars(c).union(found.select("a", "b"))) if found.take(1) else c
    near_size = lambda x, y: (100 * F.least(x, y)) >= (percent * F.greatest(x, y))

    pairs = shared.where(near_size(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tried = _measured(pairs, payload, percent, size)
    found = links(tried)
    comp = connected_components(found)

    # members of a band outside the component that its best linked document is in try that one
    placed = shared.join(tried, (F.col("hub") == F.col("a")) & (F.col("rep") == F.col("b")), "left")
    placed = written(placed.select("key", "hub", "rep", "n", "hub_n", "lo", "hi"), "placed")
    forget(shared)
    in_ = lambda c: placed.join(c.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    degree = found.select(F.col("a").alias("id")).union(found.select("b")).groupBy("id").agg(F.count("*").alias("degree"))
    best = comp.join(degree, "id").groupBy("component").agg(F.max(F.struct("degree", "id")).alias("s"))
    best = unaligned(best.select("component", "s.degree", F.col("s.id").alias("star")), "component")
    own = in_(comp.join(best, "component", "left"))
    star = own.where("star IS NOT NULL").groupBy("key").agg(F.max(F.struct("degree", "star", "component")).alias("s"))
    star = unaligned(star.select("key", F.col("s.star").alias("a"), F.col("s.component").alias("home")), "key")
    again = own.select("key", "rep", "component").join(star, "key").where("component <> home AND rep <> a").select("a", F.col("rep").alias("b")).distinct()
    more = _measured(again.join(tried.select("a", "b"), ["a", "b"], "left_anti"), payload, percent, size)
    tried = tried.union(more)
    comp = grown(comp, links(more))
    del again, star, own, best, degree
    tidy(docs.sparkSession)

    # what a band still holds in different components
    own = in_(comp)
    split = own.groupBy("key").agg(F.min("component").alias("lowest"), F.max("component").alias("highest")).where("lowest <> highest")
    pivots = tried.groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("hi", "lo", F.col("a").alias("pivot"))).alias("p"))
    pivots = pivots.select("rep", "p.pivot", F.col("p.hi").alias("pivot_hi"), F.col("p.lo").alias("pivot_lo"))
    left = own.join(unaligned(split.select("key"), "key"), "key").join(pivots, "rep", "left")
    left = mixed_bands = written(left, "mixed-bands")
    forget(placed)
    del own, split, pivots
    tidy(docs.sparkSession)
    # Shingles that no other document of these holds can't be in an intersection. Those of
    # x that its hub h holds aren't among them, since h is one of these, so for the others
    # |x and y| <= min(|x and h|, |y and h|) + min(|others of x|, |others of y|),
    # and likewise with the document that x and y both overlap most with (their pivot).
    these = left.select("rep").union(left.select("hub")).union(left.where("pivot IS NOT NULL").select("pivot")).distinct()
    lone = checkpoint(_lone(payload.join(these, "rep"), size))
    tidy(docs.sparkSession)
    left = left.join(lone, "rep", "left").withColumn("held", F.col("n") - F.coalesce("lone", F.lit(0)))
    left = left.where(enough(F.col("held"), F.col("n"))).select(
        "key",
        "rep",
        "n",
        "component",
        "held",
        F.coalesce("hi", F.least("n", "hub_n")).alias("inside"),
        (F.col("held") - F.coalesce("lo", F.lit(0))).alias("outside"),
        "pivot",
        F.col("pivot_hi").alias("most"),
        (F.col("held") - F.col("pivot_lo")).alias("beyond"),
    )
    bands_of = left.groupBy("rep").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    left = checkpoint(left.join(bands_of, "rep"))
    forget(mixed_bands)
    del bands_of
    tidy(docs.sparkSession)
    x, y = left.alias("x"), left.alias("y")
    most = F.least(F.least("x.inside", "y.inside") + F.least("x.outside", "y.outside"), "x.held", "y.held")
    by_pivot = F.least("x.most", "y.most") + F.least("x.beyond", "y.beyond")
    most = F.when(F.col("x.pivot") == F.col("y.pivot"), F.least(most, by_pivot)).otherwise(most)
    possible = (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & enough(most, F.col("x.n") + F.col("y.n") - most)
    here = F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key")  # once, though the pair shares many bands
    more = x.join(y, (F.col("x.key") == F.col("y.key")) & possible & here).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = checkpoint(more.join(done, ["a", "b"], "left_anti"))
    tidy(docs.sparkSession)
    likely = _measured(more, payload, percent, size, exact=False).select("a", "b")
    second = _measured(likely, payload, percent, size)
    forget(payload)
    comp = grown(comp, links(second))
    linked = groups.join(comp, F.col("rep") == F.col("id"))
    least = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    classes = linked.join(least, "component").select("set_hash", "smallest")
    alone = groups.where("copies > 1").join(comp, F.col("rep") == F.col("id"), "left_anti").select("set_hash", F.col("least").alias("smallest"))
    out = sk.select("doc_id", "n", "set_hash", "thash").join(classes.union(alone).withColumn("hit", F.lit(True)), "set_hash", "left")
    component = F.when(F.col("hit") & (F.col("n") > 0), F.coalesce("smallest", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("thash").alias("text_hash"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
