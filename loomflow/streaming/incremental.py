"""Incremental scans of growing folders, such as date-partitioned manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def scan_new(spark: SparkSession, path: str, schema: str, state: str, handle: Callable[[DataFrame, int], None], kind: str = "parquet", files_per_batch: int = 1000) -> int:
    """Hands every file that earlier calls with the same ``state`` folder haven't seen to
    ``handle(batch, number)``, then returns the number of rows. A call that is cut off
    starts its unfinished batch again, so ``handle`` should be idempotent per number."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").format(kind).load(path)
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)


def follow(spark: SparkSession, path: str, schema: str, state: str, out: str, transform: Callable[[DataFrame], DataFrame], kind: str = "parquet", once: bool = True) -> None:
    """Streams a folder through ``transform`` into Parquet with exactly-once files."""
    stream = transform(spark.readStream.schema(schema).format(kind).load(path))
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append")
    (writer.trigger(availableNow=True) if once else writer).start().awaitTermination()
