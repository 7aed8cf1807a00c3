"""A corpus from raw documents to packed sequences, in five stages.

Each stage works on all that the one before kept. What it returns is written as
Parquet in the shared folder and read again, so a lost executor costs at most a part
of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from basalt.llm import exact_dedup, minhash, packing, secret_scan, toxicity
from basalt.llm.queries import remainder, tokenizer_path
from basalt.plans.durable import checkpoint, written

#: Fitted models and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it no column of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5; labels of ids whose crc32 is a multiple of 5 aren't learned from.

    Null text is empty. Null ids are scored and never learned from, repeated rows share a score.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 5) != 0)
    model = toxicity.fit(toxicity.labelled(docs, labels))
    name = free_name(docs, "toxicity")
    return toxicity.score(docs, model, score_col=name).where(F.col(name) < 0.5).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id.

    Null text is empty, and null ids come last. Of a repeated row one stays.
    """
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest doc_id.

    Texts without words (null, empty, blank) all stay. A null id stays only if no other document is near.
    """
    gone = minhash.near_duplicates(docs, percent=80, size=5).where("NOT kept")
    gone = checkpoint(gone.select(F.struct("doc_id", "text_hash").alias("of")).distinct())
    id_, hash_ = free_name(docs, "gone_id"), free_name(docs, "gone_hash")
    gone = gone.select(F.col("of.doc_id").alias(id_), F.col("of.text_hash").alias(hash_))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[id_]) & F.xxhash64(docs["text"]).eqNullSafe(gone[hash_]), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with live credentials masked; examples that many owners hold stay readable.

    Null text and texts without live credentials stay as they are, with their n_chars.
    Repeated rows and null ids are masked alike.
    """
    found = secret_scan.scan(docs).where(F.size("live") > 0)
    id_, hash_, live = (free_name(docs, c) for c in ("found_id", "found_hash", "live"))
    found = found.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("live").alias(live)).dropDuplicates([id_, hash_])
    names = docs.columns
    both = docs.join(found, docs["doc_id"].eqNullSafe(found[id_]) & (F.xxhash64(docs["text"]) == found[hash_]), "left")
    masked = free_name(both, "masked")
    both = both.withColumn(masked, secret_scan.mask(F.col("text"), F.col(live)))
    hit = F.col(live).isNotNull()
    out = {"text": F.when(hit, F.col(masked)).otherwise(F.col("text")), "n_chars": F.when(hit, F.length(masked).cast("bigint")).otherwise(F.col("n_chars"))}
    return both.select(*(out[c].alias(c) if c in out else F.col(f"`{c}`") for c in names))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens, with their ids (little-endian unsigned 32-bit).

    Null and empty texts are the end id alone; each repeated row is a document of its own.
    """
    packed = packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096)
    return packed.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("secret scan", mask_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
