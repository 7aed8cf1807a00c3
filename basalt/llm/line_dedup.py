"""Deduplication of lines within an edit distance, by segment partition.

Two lines within ``distance`` edits agree exactly in one of distance + 1 segments
of the shorter one. Each distinct line is indexed under its own segments and
probes, for each length that a partner may have, the substrings that can meet a
segment (the multi-match-aware window around its place). Candidates whose counts
of some characters differ too much drop out; the others are verified by a banded
bit-parallel edit distance. Everything is a DataFrame expression.

A key that many lines are indexed under is hot. Lines there meet under finer keys
instead: what lies left and right of the segment has its own share of the edits, is
cut into more parts than these can touch, and all untouched parts join the key.

What counts in the end is which lines links join. So a family of like lines costs one star
of pairs, not all: further pairs are made only between what isn't joined yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basalt.llm.components import connected_components, unaligned
from basalt.plans.durable import checkpoint, tidy, written

#: Bits of the filter of candidate lines: 2 MB, whatever the input, so it can be broadcast.
FILTER_BITS = 1 << 24
#: Characters counted in a candidate's profile; the more of a text they cover, the more pairs they tell apart.
COUNTED = " eniatosrhldcumfpgwybvk.,"
COUNTS = 6  # of ten bits each, in one number of a profile
#: Lines indexed under one key, beyond which finer keys take its place.
HOT = 16
#: Rounds in which one line under a finer key is held against the others, and pairs a line after which no more are made.
STARS, FEW = 6, 16


def profile(line: str = "line") -> Column:
    """The counts of COUNTED in a line, in some numbers; larger counts are cut, which only brings lines closer."""
    count = lambda c: f"cast(least(1023, length({line}) - length(replace({line}, '{c}', ''))) as bigint)"
    runs = [COUNTED[k : k + COUNTS] for k in range(0, len(COUNTED), COUNTS)]
    return F.array(*(F.expr(" | ".join(f"shiftleft({count(c)}, {10 * k})" for k, c in enumerate(run))) for run in runs))


def alike(a: str, b: str, distance: int) -> Column:
    """Profiles that ``distance`` edits may lie between: an edit changes two counts by one at most."""
    count = lambda p, k: f"(shiftright({p}[{k // COUNTS}], {10 * (k % COUNTS)}) & 1023)"
    return F.expr(" + ".join(f"abs({count(a, k)} - {count(b, k)})" for k in range(len(COUNTED))) + f" <= {2 * distance}")


def _segment(length: str, i: int, parts: int) -> tuple[str, str]:
    """Start (from 1) and size of segment ``i`` of ``parts``, as SQL over an integer; the last ones take the rest."""
    size, rest = f"({length} div {parts})", f"({length} % {parts})"
    start = f"({size} * {i} + greatest(0, {i - parts} + {rest}) + 1)"  # one more for each larger segment before it
    return start, f"({size} + if({i} >= {parts} - {rest}, 1, 0))"


def _places(distance: int, shorter: range, windowed: bool) -> list[tuple[int, int, int]]:
    """(d, i, shift) of each key of a line: it may be ``d`` longer than a partner, whose segment ``i`` lies ``shift`` further on in it."""
    out = []
    for d in shorter:
        for i in range(distance + 1):
            lo, hi = (max(-i, d - (distance - i)), min(i, d + (distance - i))) if windowed else (0, 0)
            out += [(d, i, shift) for shift in range(lo, hi + 1)]
    return out


def _keys(lines: DataFrame, distance: int, shorter: range, windowed: bool) -> DataFrame:
    """(h, keys): hashes of segments of partners' lengths, ``shorter`` than ``n``, cut from the line.

    ``windowed`` tries all places that can meet a segment when ``distance`` edits are all
    there is. Places are columns of their own, which keeps the code of each step small.
    ``wide`` has four bytes a character, so a segment is found without counting characters.
    """
    places = []
    for d in shorter:
        for i in range(distance + 1):
            start, size = _segment(f"(n - {d})", i, distance + 1)
            places += [F.expr(f"cast(4 * {start} - 3 as int)").alias(f"at_{d}_{i}"), F.expr(f"cast(4 * {size} as int)").alias(f"size_{d}_{i}")]
    keys = [f"xxhash64(n - {d}, {i}, substring(wide, at_{d}_{i} + {4 * shift}, size_{d}_{i}))" for d, i, shift in _places(distance, shorter, windowed)]
    return lines.select("h", "n", "wide", *places).select("h", F.expr(f"array({', '.join(keys)})").alias("keys"))


def _touched(edits: int, windowed: bool) -> list[tuple[int, int, int, int]]:
    """(parts, p, q, drift): ways in which ``edits`` edits touch parts p and q alone; between these the texts are ``drift`` apart.

    One edit touches one of 3 parts, two touch two of 5; one part with both edits is counted
    with a neighbour. More edits aren't refined: the whole side is taken as touched.
    """
    if edits == 1:
        return [(3, p, p, 0) for p in range(3)]
    if edits == 2:
        return [(5, p, q, g) for q in range(5) for p in range(q) for g in ((-1, 0, 1) if windowed and q > p + 1 else (0,))]
    return [(1, 0, 0, 0)]


def _finer(rows: DataFrame, distance: int, windowed: bool) -> DataFrame:
    """``rows`` with a column ``fine``, one row for each finer key of a line under a hot key.

    ``rows`` have ``line``, ``key``, the shorter line's length ``n`` and d, i, shift as in ``_places``.
    If segment i is the first with no more edits before it than segments, those before it
    are i and those behind it at most ``distance`` - i (which is why the windows suffice).
    """
    parts = distance + 1
    own = rows.withColumn("wide", F.encode("line", "UTF-32"))
    own = own.withColumn("head", F.expr(f"(n div {parts}) * i + greatest(0, i - {parts} + n % {parts})"))
    own = own.withColumn("tail", F.expr(f"head + (n div {parts}) + if(i >= {parts} - n % {parts}, 1, 0)"))
    names = ("lm", "lp", "lq", "lg", "rm", "rp", "rq", "rg")
    ways = F.lit(None)
    for i in range(parts):
        of = (F.struct(*(F.lit(v).alias(c) for c, v in zip(names, left + right))) for left in _touched(i, windowed) for right in _touched(distance - i, windowed))
        ways = F.when(F.col("i") == i, F.array(*of)).otherwise(ways)
    piece = lambda lo, hi, shift: f"substring(wide, cast(4 * ({lo} + {shift}) + 1 as int), cast(4 * greatest(0, ({hi}) - ({lo})) as int))"

    def side(lo: str, hi: str, c: str, before: str, after: str) -> list[str]:
        cut = lambda k: f"({lo} + (({hi} - {lo}) * {k} div w.{c}m))"
        p, q = f"w.{c}p", f"w.{c}q"
        return [piece(lo, cut(p), before), piece(cut(f"({p} + 1)"), cut(q), f"{before} + w.{c}g"), piece(cut(f"({q} + 1)"), hi, after)]

    # two edits in two places move the text by one each at most
    fits = lambda c, drift: f"(w.{c}q <= w.{c}p + 1 OR abs({drift} - w.{c}g) <= 1)"
    pieces = ", ".join(side("0", "head", "l", "0", "shift") + side("tail", "n", "r", "shift", "d"))
    fine = f"if({fits('l', 'shift')} AND {fits('r', '(d - shift)')}, xxhash64(key, w.lp, w.lq, w.rp, w.rq, {pieces}), null)"
    names = [c for c in own.columns if c not in ("wide", "head", "tail")]
    return own.withColumn("ways", ways).select(*names, F.explode(F.expr(f"array_distinct(transform(ways, w -> {fine}))")).alias("fine")).where("fine IS NOT NULL")


def _trimmed(a: Column, b: Column) -> Column:
    """The two texts without what they have in common at the start, by doubling steps."""
    steps = F.array(*(F.lit(1 << k) for k in range(20, -1, -1)))
    # a step counts if both texts have as many characters left, and the same ones
    both = F.struct(a.alias("a"), b.alias("b"))

    def step(acc: Column, s: Column) -> Column:
        x = F.substring(acc["a"], F.lit(1), s)
        same = (x == F.substring(acc["b"], F.lit(1), s)) & (F.length(x) == s)
        cut = lambda t: F.when(same, F.substring(t, s + 1, F.length(t))).otherwise(t)
        return F.struct(cut(acc["a"]).alias("a"), cut(acc["b"]).alias("b"))

    return F.aggregate(steps, both, step)


def edit_distance(x: Column, y: Column, distance: int, first: int | None = None) -> Column:
    """Edit distance of two arrays of characters if at most ``distance`` (up to 14), else a larger number.

    ``x`` isn't longer than ``y``. Column j of the distance table is kept for the
    2 * distance + 1 rows around j only, as two bit sets of the vertical steps up and
    down; a column takes a dozen bit operations. Rows before the first stand for values
    that grow away from it. The result is read off along the diagonal that ends in the
    last cell, on which values never decrease; so with ``first`` columns only it is a
    lower bound.
    """
    wide = 2 * distance + 1
    full = (1 << wide) - 1
    most = 1 << 30 if first is None else first
    gap = F.size(y) - F.size(x)
    none = F.lit(None).cast("string")
    pad = lambda k: F.slice(F.concat(F.array_repeat(none, distance - k), x), 1, most) if k < distance else F.slice(x, k - distance + 1, most)
    size = F.size(y) if first is None else F.least(F.size(y), F.lit(first))
    columns = F.slice(F.arrays_zip(F.slice(y, 1, most), *(pad(k) for k in range(wide))), F.lit(1), size)

    def matches(e: Column) -> Column:
        out = F.lit(0)
        for k in range(wide):
            out = out + F.when(e["0"] == e[str(k + 1)], 1 << k).otherwise(0)
        return out

    masks = F.transform(columns, matches)
    below = (1 << (distance + 1)) - 1
    begin = F.struct(F.lit(full ^ below).alias("up"), F.lit(below).alias("down"), gap.alias("score"), F.call_function("shiftleft", F.lit(1), F.lit(distance) - gap).alias("end"))

    def step(acc: Column, match: Column) -> Column:
        up = F.shiftright(acc["up"], 1).bitwiseOR(F.lit(1 << (wide - 1)))
        down = F.shiftright(acc["down"], 1)
        some = match.bitwiseOR(down)
        flat = (some.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(some)  # no step along the diagonal
        right_up = F.shiftleft(down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(up))), 1).bitwiseOR(F.lit(1))
        right_down = F.shiftleft(flat.bitwiseAND(up), 1)
        new = F.struct(
            right_down.bitwiseOR(F.bitwise_not(flat.bitwiseOR(right_up))).bitwiseAND(F.lit(full)).alias("up"),
            right_up.bitwiseAND(flat).bitwiseAND(F.lit(full)).alias("down"),
            (acc["score"] + F.when(flat.bitwiseAND(acc["end"]) == 0, 1).otherwise(0)).alias("score"),
            acc["end"].alias("end"),
        )
        return F.when(acc["score"] > distance, acc).otherwise(new)

    return F.when(gap > distance, gap).when(F.size(y) == 0, 0).otherwise(F.aggregate(masks, begin, step, lambda acc: acc["score"]))


def within(pairs: DataFrame, a: str, b: str, distance: int, least: int = 0) -> DataFrame:
    """Rows of ``pairs``, without the texts ``a`` and ``b``, where these differ by at most ``distance`` edits.

    If the shorter text has under ``least`` characters, one edit is the most.

    What both texts share at either end goes first. The rest is materialised, since an
    expression that is used several times would be evaluated as often.
    """
    names = [*(c for c in pairs.columns if c not in (a, b)), "__most"]
    pairs = pairs.withColumn("__most", F.when(F.least(F.length(a), F.length(b)) < least, 1).otherwise(distance))
    swap = F.length(a) > F.length(b)
    short, long = F.when(swap, F.col(b)).otherwise(F.col(a)), F.when(swap, F.col(a)).otherwise(F.col(b))
    near = pairs.where(F.abs(F.length(a) - F.length(b)) <= distance)
    head = checkpoint(near.select(*names, _trimmed(F.reverse(short), F.reverse(long)).alias("__t")))
    tidy(pairs.sparkSession)
    both = checkpoint(head.select(*names, _trimmed(F.reverse("__t.a"), F.reverse("__t.b")).alias("__t")))
    chars = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    both = checkpoint(both.select(*names, chars("__t.a").alias("__x"), chars("__t.b").alias("__y")))
    close = lambda first: edit_distance(F.col("__x"), F.col("__y"), distance, first) <= F.col("__most")
    return both.where(close(8 * (distance + 1))).where(close(None)).select(*names).drop("__most")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def _hashed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _met(own: DataFrame, tiers: list[tuple[int, int, int | None]]) -> DataFrame:
    """Keys that two lines share, or one that a line shares with a hot key.

    ``own`` is (h, n, wide) of distinct lines. A tier is (edits, least, below): lengths of the
    shorter line, which are part of the key. Rows are (x, y, key, edits, d, i, shift): x was
    indexed and y probed under the key. For hot keys x is null, and y was indexed as well where
    d and shift are 0, for lines probe their own segments too.
    """

    # an outer explode, for a plain one also filters by its array, below the shuffle of the lines
    def spread(h: str, windowed: bool) -> DataFrame:
        out = None
        for edits, least, below in tiers:
            reach = own.where(F.col("n") >= least)
            if below is not None:
                reach = reach.where(F.col("n") < below + (edits if windowed else 0))
            keys = _keys(reach, edits, range(edits + 1 if windowed else 1), windowed)
            keys = keys.select(F.col("h").alias(h), F.posexplode_outer("keys").alias("pos", "key"), F.lit(edits).alias("edits"))
            out = keys if out is None else out.union(keys)
        return out

    def place() -> Column:
        out = F.lit(None)
        for edits, *_ in tiers:
            of = _places(edits, range(edits + 1), True)
            of = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("d", "i", "shift"), at))) for at in of))
            out = F.when(F.col("edits") == edits, F.get(of, F.col("pos"))).otherwise(out)
        return out.alias("place")

    index, probe = spread("x", False), spread("y", True)
    hot = checkpoint(index.groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > HOT).select("key"))
    marks = index.join(unaligned(hot, "key"), "key", "left_anti").select("key", "x").union(hot.select("key", F.lit(None).cast("bigint")))
    met = marks.join(probe, "key").where("x IS NULL OR x <> y").select("x", "y", "key", "edits", place())
    return checkpoint(met.select("x", "y", "key", "edits", "place.*"))


def _fine_rows(hot: DataFrame, texts: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(indexed, probing): (id, key, p, fine, d) of ``hot`` rows (id, key, d, i, shift) by their finer keys."""

    def finer(probes: bool) -> DataFrame:
        rows = (hot if probes else hot.where("d = 0 AND shift = 0")).join(texts.select("id", "line", "p"), "id").withColumn("n", F.length("line") - F.col("d"))
        return written(_finer(rows, distance, probes).select("id", "key", "p", "fine", "d"), "finer")

    return finer(False), finer(True)


def _across(hot: DataFrame, component: DataFrame) -> DataFrame:
    """``hot`` rows with ``c``, the component of each line, and ``odd``: whether it isn't the one that most indexed lines under the key have.

    Keys whose lines are all in one component are left out: a link there joins nothing.
    """
    named = hot.join(component, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    own = named.where("d = 0 AND shift = 0").groupBy("key", "c").agg(F.count("*").alias("n"))
    most = own.groupBy("key").agg(F.max_by("c", F.struct("n", "c")).alias("most"))
    marked = named.join(unaligned(most, "key"), "key").withColumn("odd", F.col("c") != F.col("most")).drop("most")
    mixed = marked.where("odd").select("key").distinct()
    return checkpoint(marked.join(unaligned(mixed, "key"), "key", "left_semi"))


def _crowd(x: DataFrame, y: DataFrame) -> tuple[int, int]:
    """(pairs under finer keys with an odd line, rows)."""
    flag = lambda rows, side: rows.select("fine", F.lit(side).alias("x"), "odd")
    n = flag(x, True).union(flag(y, False)).groupBy("fine").agg(*(F.count_if(F.expr(c)).alias(a) for a, c in (("xs", "x"), ("xs_odd", "x AND odd"), ("ys", "NOT x"), ("ys_odd", "NOT x AND odd"))))
    sums = n.agg(F.coalesce(F.sum(F.expr("xs_odd * ys + (xs - xs_odd) * ys_odd")), F.lit(0)), F.coalesce(F.sum(F.expr("xs + ys")), F.lit(0)))
    return tuple(sums.first())


def _pairs(x: DataFrame, y: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of indexed and probing lines under one finer key, in different components, with similar counts of characters."""
    x = x.select("fine", F.col("id").alias("x"), F.col("p").alias("p_x"), F.col("c").alias("c_x"))
    both = x.join(y, "fine").where("x <> id AND c_x <> c").where(alike("p_x", "p", distance))
    return both.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b"))


def _only(lines: DataFrame, hashes: DataFrame) -> DataFrame:
    """Rows of ``lines`` whose ``h`` may be among ``hashes``: a bit filter of fixed size is broadcast."""
    place = lambda h: F.pmod(F.xxhash64(h, F.lit(3)), F.lit(FILTER_BITS))
    bits = hashes.select(place(F.col("h")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    own = lines.withColumn("__p", place(F.col("h"))).withColumn("bucket", F.bitmap_bucket_number("__p")).withColumn("__p", F.bitmap_bit_position("__p"))
    octet = F.conv(F.hex(F.substring("bits", F.floor(F.col("__p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = octet.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(F.col("__p"), F.lit(8)).cast("int"))) != 0
    return own.join(F.broadcast(bits), "bucket").where(hit).drop("__p", "bucket", "bits")


def _linked(hot: DataFrame, tiers: list[int], cold: DataFrame, texts: DataFrame, distance: int, least: int) -> DataFrame:
    """(id, component) of all lines that links join: ``cold`` pairs and, under each finer key, pairs with one line of it first.

    In a family of lines that are all alike these make one component. Other pairs under a
    finer key are looked at only where they would join two: one of the two lines then
    isn't of the largest component there. While these are many, another line of theirs is held against all, as the first was.
    """
    side = lambda s: texts.select(F.col("id").alias(s), F.col("p").alias(f"p_{s}"), F.col("line").alias(f"line_{s}"))

    def verified(pairs: DataFrame) -> DataFrame:
        both = checkpoint(pairs.distinct()).join(side("a"), "a").join(side("b"), "b").where(alike("p_a", "p_b", distance))
        return within(both.select("a", "b", "line_a", "line_b"), "line_a", "line_b", distance, least)

    made = [(edits, *_fine_rows(hot.where(F.col("edits") == edits), texts, edits)) for edits in tiers]
    alone = lambda df: df.withColumns({"c": F.col("id"), "odd": F.lit(True)})
    rows = [(edits, alone(x), alone(y)) for edits, x, y in made]
    hub = lambda x: x.where("odd").groupBy("fine").agg(F.min(F.struct("id", "p", "c")).alias("h")).select("fine", "h.*")
    cand, links = cold, None
    for _ in range(STARS):
        for edits, x, y in rows:
            cand = cand.union(_pairs(hub(x), y, edits))
        new = verified(cand)
        links = checkpoint(new if links is None else links.union(new))
        tidy(texts.sparkSession)
        component = connected_components(links)
        mixed = _across(hot, component)
        if mixed.isEmpty():
            return component
        marks = mixed.select("id", "key", "c", "odd").distinct()
        rows = [(edits, *(checkpoint(side_.join(marks, ["id", "key"])) for side_ in sides)) for edits, *sides in made]
        cand = links.limit(0)
        crowds = [_crowd(x, y) for _, x, y in rows]
        if sum(c[0] for c in crowds) <= FEW * sum(c[1] for c in crowds):
            break
    for edits, x, y in rows:  # either line of a pair may be the odd one
        cand = cand.union(_pairs(x.where("odd"), y, edits)).union(_pairs(x.where("NOT odd"), y.where("odd"), edits))
    return connected_components(checkpoint(links.union(verified(cand))))


def near_lines(docs: DataFrame, distance: int = 2, least: int = 20, short: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_kept, n_exact, n_near, dropped.

    Lines (text between line feeds) are in one class if equal, or if links join them: of at
    most ``distance`` edits where the shorter line has ``least`` characters or more, of one
    edit where it has ``short`` or more (0: never). What is shorter still is equal or not:
    an edit would be a large part of it. Blank lines always stay. Of a class the line first
    in order of (doc_id, place) stays; ``dropped`` lists the places of all others, from 0,
    joined by commas, ``n_exact`` of which equal the line that stays and ``n_near`` don't.

    Null text is one empty line. Null ids come first; repeated rows (same id and text)
    share their decisions. An empty table gives no rows; other columns are ignored.
    """
    if least <= 2 * distance or short and not 2 < short < least:
        raise ValueError("lines must have more characters than two segments' worth of edits")
    lines = _lines(docs, id_col, text_col).where(F.trim("line") != "")
    long = F.length("line") >= (short or least)
    # read by the count of keys, by the join under them and by the look-up of texts
    own = lines.where(long).select("line").distinct()
    own = written(own.select(F.xxhash64("line").alias("h"), F.length("line").alias("n"), "line"), "lines")
    tiers = [(distance, least, None), *([(1, short, least)] if short else [])]
    met = _met(own.select("h", "n", F.encode("line", "UTF-32").alias("wide")), tiers)
    cold = met.where("x IS NOT NULL").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    cold = checkpoint(cold.distinct())
    tidy(docs.sparkSession)
    hot = met.where("x IS NULL").select("y")
    wanted = cold.select(F.col("a").alias("h")).union(cold.select("b")).union(hot).distinct()
    texts = _only(own.select("h", "line"), wanted)
    texts = checkpoint(texts.join(wanted, "h").withColumn("id", F.monotonically_increasing_id()).withColumn("p", profile()))
    ids = texts.select("h", "id")
    cand = cold.join(ids.select(F.col("h").alias("a"), F.col("id").alias("id_a")), "a").join(ids.select(F.col("h").alias("b"), F.col("id").alias("id_b")), "b")
    under = met.where("x IS NULL").select(F.col("y").alias("h"), "key", "edits", "d", "i", "shift").join(ids, "h").drop("h")
    under = checkpoint(under)
    component = _linked(under, [t[0] for t in tiers], cand.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), texts, distance, least)
    linked = texts.join(component, "id").select("component", "line")
    linked = checkpoint(_hashed(linked).select("component", "h1", "h2"))
    del cold, hot, wanted, met, cand, under, component
    tidy(docs.sparkSession)
    name = linked.groupBy("component").agg(F.min(F.struct("h1", "h2")).alias("class"))
    linked = linked.join(name, "component").select("h1", "h2", "class")

    occ = _hashed(lines).select("doc_id", "doc", "line_no", "h1", "h2")
    often = occ.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    alone = often.join(linked, ["h1", "h2"], "left_anti").select("h1", "h2", F.struct("h1", "h2").alias("class"))
    many = checkpoint(occ.join(linked.union(alone), ["h1", "h2"]).withColumn("class_key", F.xxhash64("class")))
    first = many.groupBy("class", "class_key").agg(F.min(F.struct("doc_id", "line_no", "doc", "h1", "h2")).alias("first"))
    first = unaligned(first.select(F.col("class").alias("of"), "class_key", "first"), "class_key")
    judged = many.join(first, "class_key").where("class = of")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no")) & (F.col("doc") == F.col("first.doc"))
    same = (F.col("h1") == F.col("first.h1")) & (F.col("h2") == F.col("first.h2"))
    gone = judged.where(~stays).select("doc_id", "doc", "line_no", same.alias("same")).distinct()
    gone = gone.groupBy("doc_id", "doc").agg(F.array_sort(F.collect_list("line_no")).alias("dropped"), F.count_if("same").alias("n_exact"), F.count("*").alias("n_dropped"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("own"), F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"))
    out = own.join(gone, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("own") == F.col("doc")), "left")
    n, exact = F.coalesce("n_dropped", F.lit(0)), F.coalesce("n_exact", F.lit(0))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_lines",
        (F.col("n_lines") - n).alias("n_kept"),
        exact.alias("n_exact"),
        (n - exact).alias("n_near"),
        F.coalesce(F.array_join(F.col("dropped").cast("array<string>"), ","), F.lit("")).alias("dropped"),
    )


def without(text: Column, dropped: Column) -> Column:
    """``text`` without the lines at the places that ``dropped`` lists."""
    gone = F.transform(F.filter(F.split(dropped, ","), lambda s: s != ""), lambda s: s.cast("int"))
    return F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i)), "\n")
