"""A journal fed by a stream of objects (a Spark-native extra).

Each micro-batch is verified and appended like ``store.put``; replayed batches write
nothing twice, since an object's name is its digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from basalt.sources import store


def journal_stream(objects: DataFrame, path: str, checkpoint: str):
    """Start a query that appends a stream of (data binary) to the journal at ``path``."""

    def append(batch: DataFrame, _: int) -> None:
        store.put(batch.sparkSession, path, batch.select(F.sha2("data", 256).alias("sha256"), "data"))

    return objects.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
