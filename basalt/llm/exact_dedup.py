"""Exact deduplication: tree-merge of sorted digest runs.

Every input partition becomes one sorted run of (digest, smallest row, count).
Runs are then exchanged in rounds of a k-ary (binomial for k = 2) tree: in round
r the k runs whose numbers differ only in their r-th base-k digit meet, and
member j of such a group takes over the entries whose digest has j as its r-th
digit. After log_k(runs) rounds each run holds one digest range, complete. At
each level equal digests are merged to their smallest identifier, so a text with
any number of copies contributes at most k rows to any merge and no task ever
sees a whole group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from basalt.plans.durable import checkpoint

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, length, check, run, row) of every row, materialised.

    ``row`` tells repeated rows with one identifier apart. ``check`` and
    ``length`` are independent of ``digest`` and verify each match.
    """
    out = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("t")).select(
        "doc_id",
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("length"),
        F.xxhash64("t").alias("check"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return checkpoint(out)


def _merge(df: DataFrame, keep: str, count: Column) -> DataFrame:
    """Merge what has met in a run: one row per verified digest, sorted by it."""
    return df.groupBy("run", "digest", "length", "check").agg(F.min(keep).alias("keep"), F.sum(count).alias("n"))


def merged_runs(dig: DataFrame, fan_in: int = 16) -> DataFrame:
    """(digest, length, check, keep, n), each verified digest once."""
    runs = max(1, dig.rdd.getNumPartitions())
    leaf = dig.withColumn("keep", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    level = leaf.repartitionById(runs, F.col("run"))
    level = _merge(level, "keep", F.lit(1))
    width, span = 1, max(2, min(fan_in, runs))
    # 48 bits of the digest, as a number whose base-k digits place the entry
    place = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("bigint")
    while width < runs:
        group = span * width
        digit = F.pmod(F.floor(place / F.lit(width)), F.lit(span))
        own = F.pmod(F.floor(F.col("run") / F.lit(width)), F.lit(span))
        target = (F.col("run") + (digit - own) * F.lit(width)).cast("int")
        level = level.withColumn("run", target)
        slots = -(-runs // group) * group
        level = _merge(level.repartitionById(slots, F.col("run")), "keep", F.col("n"))
        width = group
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``; null text is empty.
    Of equal texts the row with the smallest identifier stays (null identifiers
    last; of repeated rows with that identifier, one). An empty table gives no
    rows; further columns of ``docs``, whatever their names, are ignored.
    """
    dig = digests(docs, id_col, text_col)
    groups = merged_runs(dig, fan_in).where("n > 1").select("digest", "length", "check", "keep", "n")
    many = dig.join(groups, ["digest", "length", "check"], "left")
    first = F.col("n").isNull()
    return many.select(
        "doc_id",
        F.when(first, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (first | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("row").alias("row_no"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 16) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Only the keys of dropped rows meet the texts again. A repeated row (same
    identifier and text) stays once.
    """
    names = docs.columns
    taken = {c.lower() for c in names}

    def free(name: str) -> str:
        while name in taken:
            name = f"_{name}"
        return name

    id_, sha, repeat, own_sha = free("gone_id"), free("gone_sha"), free("gone_repeat"), free("own_sha")
    gone = (
        exact_dedup(docs, id_col, text_col, fan_in)
        .where("NOT kept")
        .select(
            F.col("doc_id").alias(id_),
            F.col("text_sha256").alias(sha),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias(repeat),
        )
        .distinct()
    )
    gone = checkpoint(gone)
    own = docs.withColumn(own_sha, F.sha2(normalised(F.col(text_col)), 256))

    def meets(keys: DataFrame, how: str) -> DataFrame:
        return own.join(keys, own[id_col].eqNullSafe(keys[id_]) & (own[own_sha] == keys[sha]), how)

    stays = meets(gone, "left_anti")
    once = meets(gone.where(F.col(repeat)), "left_semi").dropDuplicates([id_col, own_sha])
    return stays.unionByName(once).select(*(F.col(f"`{c}`") for c in names))
