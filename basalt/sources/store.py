"""Content-addressed objects: digest -> bytes, written once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from basalt.operators.validate import CatalogError
from basalt.plans.limits import JOURNAL_ENTRIES

# The names of committed and of half-written objects.
COMMITTED, TEMPORARY = r"^[0-9a-f]{64}\.pkg$", r"^\.tmp-[0-9a-f]+$"


def verified(objects: DataFrame) -> DataFrame:
    """(sha256, data, ok)."""
    return objects.withColumn("ok", F.sha2("data", 256) == F.col("sha256"))


def new_objects(objects: DataFrame, stored: DataFrame) -> DataFrame:
    """What a put must write: objects not stored yet, each digest once."""
    return objects.dropDuplicates(["sha256"]).join(stored.select("sha256"), "sha256", "left_anti")


def put(spark: SparkSession, path: str, objects: DataFrame) -> int:
    """Append objects under their digests; a repeated put writes nothing. Returns how many were written.

    Objects whose digest is wrong fail the whole put. Not a replacement for fsync: what the
    file system has acknowledged is what is durable.
    """
    if not verified(objects).where("NOT ok").isEmpty():
        raise CatalogError("binding", "digest of an object")
    new = new_objects(objects, read(spark, path))
    n = new.count()
    if n:
        new.select("sha256", "data").write.mode("append").parquet(path)
    return n


def read(spark: SparkSession, path: str) -> DataFrame:
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    return spark.read.schema("sha256 string, data binary").parquet(path) if there else spark.createDataFrame([], "sha256 string, data binary")


def get(spark: SparkSession, path: str, sha256: str) -> bytes:
    """One object, its digest checked."""
    if not re.fullmatch("[0-9a-f]{64}", sha256):
        raise CatalogError("input", "digest")
    rows = verified(read(spark, path).where(F.col("sha256") == sha256)).limit(1).collect()
    if not rows:
        raise CatalogError("reference", sha256)
    if not rows[0]["ok"]:
        raise CatalogError("binding", sha256)
    return bytes(rows[0]["data"])


def classify_names(names: DataFrame, name: str = "name") -> DataFrame:
    """``class``: committed, temporary or unknown; ``sha256`` of committed names."""
    kind = F.when(F.col(name).rlike(COMMITTED), "committed").when(F.col(name).rlike(TEMPORARY), "temporary").otherwise("unknown")
    return names.withColumn("class", kind).withColumn("sha256", F.when(kind == "committed", F.substring(name, 1, 64)))


def list_digests(names: DataFrame, most: int | None = JOURNAL_ENTRIES) -> DataFrame:
    """Digests in order. Unknown names, and more names than ``most`` (None: any number), are errors; nothing is cut off."""
    if most is not None and names.limit(most + 1).count() > most:
        raise CatalogError("limit", "directory entries")
    found = classify_names(names)
    if not found.where("class = 'unknown'").isEmpty():
        raise CatalogError("input", "unknown name")
    return found.where("class = 'committed'").select("sha256").orderBy("sha256")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name) of the files of a folder, read without their contents."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return files


def readback(sent: DataFrame, back: DataFrame, key: str) -> DataFrame:
    """(key, state): what came back compared with what was sent. Both: key, sha256, bytes."""
    b = back.select(key, F.col("sha256").alias("b_sha256"), F.col("bytes").alias("b_bytes"))
    state = (
        F.when(F.col("b_bytes").isNull(), "absent")
        .when(F.col("b_bytes") != F.col("bytes"), "length")
        .when(F.col("b_sha256") != F.col("sha256"), "digest")
        .otherwise("verified")
    )
    return sent.join(b, key, "left").select(key, state.alias("state"))


def page_manifest(pages: DataFrame, url, html) -> DataFrame:
    """(url, sha256, bytes, links): each canonical URL once, its first body by digest."""
    link = F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))
    p = pages.select(url.alias("url"), F.sha2(html, 256).alias("sha256"), F.octet_length(html).cast("bigint").alias("bytes"), F.size(F.array_distinct(link)).cast("bigint").alias("links"))
    return p.where("url IS NOT NULL").groupBy("url").agg(F.min(F.struct("sha256", "bytes", "links")).alias("x")).select("url", "x.*")
