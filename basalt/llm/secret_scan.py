"""Secret scans with corpus-wide ownership frequency.

Three base kinds are found by pattern. A fourth, ``bare``, takes long mixed
tokens that no base match covers. The hashes of all candidate values are then
counted over the whole corpus by distinct repositories and owners: a value that
many owners hold, or several in many repositories, is a copied example; any other
is a live credential unless it says that it is a placeholder. Only bare candidates must also look
random; they are reported only when live, base matches always. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from basalt.plans.durable import checkpoint

# The patterns of the kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "bare")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a maximal run, so equal to AKIA[A-Z0-9]+ kept from 18 characters
HEX = r"[0-9a-f]{16,}"  # likewise
BARE = r"[A-Za-z0-9_-]{24,}"
LEAST_ASSIGNED = 12

SPAN = "struct<start:int,k:int,end:int,value:string>"


def running(values: Column, join: Callable[[Column, Column], Column], neutral: int) -> Column:
    """Running sums, maxima and the like of an array of integers, in doubling steps: n log n."""

    def step(acc: Column, k: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(neutral), F.call_function("shiftleft", F.lit(1), k)), acc)
        longer = F.slice(F.zip_with(acc, moved, join), F.lit(1), F.size(acc))
        return F.when(F.size(acc) > F.call_function("shiftleft", F.lit(1), k), longer).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(k) for k in range(28))), values, step)


def apart(spans: Column, others: Column) -> Column:
    """The ``spans`` that overlap none of ``others``."""
    # 0: another, 1: own; of equal starts the others come first
    own = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("own"), s["end"].alias("end"), s.alias("span"))
    both = F.array_sort(F.concat(F.transform(others, own(0)), F.transform(spans, own(1))))

    def free(x: Column) -> Column:
        before = running(F.transform(x, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(0)), lambda a, b: F.greatest(a, b), 0)
        far = (1 << 31) - 1
        after = F.reverse(running(F.transform(F.reverse(x), lambda s: F.when(s["own"] == 0, s["start"]).otherwise(far)), lambda a, b: F.least(a, b), far))
        left = F.zip_with(x, before, lambda s, b: F.when((s["own"] == 1) & (b <= s["start"]), s))
        right = F.zip_with(left, after, lambda s, a: F.when(a >= s["end"], s["span"]))
        return F.filter(right, lambda s: s.isNotNull())

    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.flatten(F.transform(F.array(both), free))).otherwise(spans)


def _spans(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """All matches as (start, k, end, value), in code points, end exclusive.

    What lies between matches comes from splitting at the same pattern, and the
    running sum of both lengths gives the positions.
    """
    rest = F.split(text, pattern, -1)
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    zipped = F.filter(F.arrays_zip(rest, full, value), lambda x: x["1"].isNotNull())

    def spans(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: F.length(x["0"]) + F.length(x["1"])), lambda a, b: a + b, 0)
        return F.zip_with(ends, z, lambda end, x: F.struct((end - F.length(x["1"])).alias("start"), F.lit(kind).alias("k"), end.alias("end"), x["2"].alias("value")))

    # a list of one, so that what it holds is computed once
    found = F.flatten(F.transform(F.array(zipped), spans))
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def placeholder(value: Column) -> Column:
    return value.rlike("(?i)example|sample|dummy|placeholder")


def live_looking(value: Column) -> Column:
    """Mixed, varied characters: digits, letters, and ten different characters or more."""
    return (
        value.rlike("[0-9].*[0-9].*[0-9]")
        & value.rlike("[A-Za-z].*[A-Za-z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= 10)
        & ~placeholder(value)
    )


def find_spans(text: Column) -> tuple[Column, Column]:
    """Sorted base spans, and bare spans that look live."""
    assign = F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= LEAST_ASSIGNED)
    base = F.array_sort(F.concat(assign, _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    return base, F.filter(_spans(text, BARE, 3), lambda s: live_looking(s["value"]))


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repo_cols: tuple[str, ...] = ("source", "lang"),
    owner_col: str = "source",
    example_owners: int = 3,
    example_repos: int = 6,
) -> DataFrame:
    """One row per input row: doc_id, row, text_hash, and base, added, live, examples (span arrays).

    ``base`` holds every match of the base kinds, ``added`` the bare spans whose
    value is live, ``live`` all spans judged live and ``examples`` those whose
    value ``example_owners`` owners or more hold, or two or more in ``example_repos``
    repositories. Copies in any number of repositories of one owner are no example: they
    aren't independent, and a leaked key is still live there. Spans are (start, k, end,
    value) with k an index into KINDS.

    Null text is empty. Null owners and repositories count as one owner and one
    repository. Repeated rows each give a row (``row`` tells them apart) and count once
    for their owner. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base, bare = find_spans(text)
    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols)).alias("repo"),
        F.xxhash64(F.coalesce(F.col(owner_col).cast("string"), F.lit(""))).alias("owner"),
        base.alias("base"),
        bare.alias("bare"),
        F.xxhash64(text_col).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    found = checkpoint(found.withColumn("bare", apart(F.col("bare"), F.col("base"))))
    some = found.where((F.size("base") > 0) | (F.size("bare") > 0))
    spans = some.select("row", "repo", "owner", F.explode(F.concat("base", "bare")).alias("s")).select(
        "row", "repo", "owner", "s", F.unhex(F.sha2("s.value", 256)).alias("hash")
    )
    # two levels of partial aggregation: a value that a third of all rows hold is a few rows per task
    held = spans.groupBy("hash", "repo", "owner").count()
    held = held.groupBy("hash").agg(F.countDistinct("repo").alias("repos"), F.countDistinct("owner").alias("owners"))
    copied = (F.col("owners") >= example_owners) | ((F.col("owners") > 1) & (F.col("repos") >= example_repos))
    # digests made anew, as Spark knows grouped ones to be spread by digest and would not split the spans of a frequent one
    held = held.withColumn("hash", F.unhex(F.hex("hash")))
    # bare candidates have passed live_looking already
    judged = spans.join(held, "hash").select("row", "s", copied.alias("example"), (~copied & ~placeholder(F.col("s.value"))).alias("live"))
    bare_kind = F.col("s.k") == len(KINDS) - 1
    picked = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("s"))))
    per_row = judged.groupBy("row").agg(
        picked(F.col("live") & bare_kind).alias("added"), picked(F.col("live")).alias("live"), picked(F.col("example") & ~bare_kind).alias("examples")
    )
    none = F.array().cast(f"array<{SPAN}>")
    out = found.join(per_row, "row", "left")
    return out.select("doc_id", "row", "text_hash", "base", *(F.coalesce(c, none).alias(c) for c in ("added", "live", "examples")))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == KINDS.index(kind))).cast("bigint")


def mask(text: Column, spans: Column, with_: str = "[SECRET]") -> Column:
    """``text`` with each sorted span replaced; overlapping spans become one mask."""

    def masked(x: Column) -> Column:
        wide, own = x["wide"], x["spans"]  # four bytes a character, so a piece is found without counting them
        seen = running(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b), 0)
        before = F.slice(F.concat(F.array(F.lit(0)), seen), F.lit(1), F.size(own))
        cut = lambda a, b: F.decode(F.substring(wide, 4 * a + 1, 4 * F.greatest(b - a, F.lit(0))), "UTF-32")
        parts = F.zip_with(own, before, lambda s, b: F.when(s["start"] >= b, F.concat(cut(b, s["start"]), F.lit(with_))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), cut(F.element_at(seen, -1), F.length(text)))

    once = F.transform(F.array(F.struct(F.encode(text, "UTF-32").alias("wide"), spans.alias("spans"))), masked)
    return F.when(F.size(spans) > 0, F.get(once, F.lit(0))).otherwise(text)
