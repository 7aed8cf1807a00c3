"""Objects that are put, replaced and deleted: an append-only log of versions over Parquet.

A commit writes its changes as one part and then a manifest that lists the parts of its
version, each with the version it came with; nothing written is ever changed. A reader keeps the manifest it
opened, so later commits don't show. Of two commits on one version only one gets its
manifest; the other is an error and leaves nothing that is read.

Keys compress well and Spark goes by the size of files, so it would broadcast tables of millions of keys
through the driver: joins by key are merges.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from basalt.operators.validate import CatalogError, duplicates, enforce

SCHEMA = "key string, role string, data binary, deleted boolean"


@dataclass(frozen=True)
class Snapshot:
    """What a reader sees: one version, whatever is committed after it was opened."""

    spark: SparkSession
    version: int
    parts: tuple[tuple[str, int], ...]

    def _log(self) -> DataFrame:
        out = None
        for place, version in self.parts:
            part = self.spark.read.schema(SCHEMA).parquet(place).withColumn("version", F.lit(version))
            out = part if out is None else out.union(part)
        return out if out is not None else self.spark.createDataFrame([], SCHEMA + ", version int")

    def objects(self, keys: list[str] | None = None) -> DataFrame:
        """(key, role, data) of all objects, or of some ``keys``, which reach the scan.

        Keys alone decide what is current; bytes move once, to meet their keys.
        """
        log = self._log()
        if keys is not None:
            log = log.where(F.col("key").isin(*keys)) if keys else log.limit(0)
        last = log.groupBy("key").agg(F.max("version").alias("version"))
        return log.join(last.hint("merge"), ["key", "version"]).where("NOT deleted").select("key", "role", "data")


class ObjectLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        at = self._path("manifests")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(at) if f.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def open(self, version: int | None = None) -> Snapshot:
        """A reader of ``version``, the latest without one. Version 0 is empty."""
        known = self.versions()
        n = version if version is not None else (known[-1] if known else 0)
        if n == 0:
            return Snapshot(self.spark, 0, ())
        if n not in known:
            raise CatalogError("reference", f"version {n}")
        stream = self._fs.open(self._path(f"manifests/{n:012d}"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(self.spark, n, tuple((place, v) for place, v in json.loads(text)))

    def _publish(self, version: int, parts: tuple[tuple[str, int], ...]) -> int:
        """Give ``version`` its manifest, unless it has one."""
        jvm = self.spark.sparkContext._jvm
        self._fs.mkdirs(self._path("manifests"))
        part = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(part, False)
        stream.write(bytearray(json.dumps(parts).encode()))
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, self._path(f"manifests/{version:012d}"), options)  # fails where the name is taken
        except Exception as e:
            self._fs.delete(part, False)
            raise CatalogError("conflict", f"version {version} was committed by another") from e
        return version

    def _commit(self, changes: DataFrame, base: Snapshot | None, must_exist: bool) -> int:
        at = base or self.open()
        place = self._fs.makeQualified(self._path(f"data/{uuid.uuid4().hex}")).toString()
        changes.select("key", "role", "data", "deleted").write.parquet(place)
        written = self.spark.read.schema(SCHEMA).parquet(place)
        enforce(written.where("key IS NULL OR (data IS NULL AND NOT deleted)").select("key"), "input")
        enforce(duplicates(written, ["key"]), "conflict")
        if must_exist:
            enforce(written.join(at.objects().select("key").hint("merge"), "key", "left_anti").select("key"), "reference")
        return self._publish(at.version + 1, (*at.parts, (place, at.version + 1)))

    def put(self, objects: DataFrame, base: Snapshot | None = None) -> int:
        """Commit objects (key, role, data), new or in place of others. Returns the version.

        A key twice, or a null one, is an error, and so is a commit between ``base`` (the latest without one) and this.
        """
        return self._commit(objects.withColumn("deleted", F.lit(False)), base, False)

    def replace(self, objects: DataFrame, base: Snapshot | None = None) -> int:
        """As ``put``, of objects that are there; their role stays."""
        at = base or self.open()
        roles = at.objects().select("key", F.col("role").alias("had"))
        own = objects.select("key", "data").join(roles.hint("merge"), "key", "left")
        return self._commit(own.select("key", F.col("had").alias("role"), "data", F.lit(False).alias("deleted")), at, True)

    def delete(self, keys: DataFrame, base: Snapshot | None = None) -> int:
        """Delete the objects of ``keys`` (key); those that aren't there are no error."""
        own = keys.select("key").distinct().select("key", F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("data"), F.lit(True).alias("deleted"))
        return self._commit(own, base, False)

    def compact(self) -> int:
        """A version with the same objects in one part, so that readers of it read each once."""
        at = self.open()
        place = self._fs.makeQualified(self._path(f"data/{uuid.uuid4().hex}")).toString()
        at.objects().withColumn("deleted", F.lit(False)).write.parquet(place)
        return self._publish(at.version + 1, ((place, at.version + 1),))

    def clone(self, path: str) -> ObjectLog:
        """A log of its own that begins with the latest version; parts are shared, commits aren't."""
        out, at = ObjectLog(self.spark, path), self.open()
        if at.version:
            out._publish(at.version, at.parts)
        return out
