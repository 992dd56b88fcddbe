"""Streams: windowed counts with late rows, and processing of files that are new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapidar.runtime import Scratch


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of a stream or table of events (ts, event_type, value); of a stream, rows that come more than late after the newest of the batches before are dropped."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drained(spark: SparkSession, stream: DataFrame, change: Callable[[DataFrame], DataFrame], keys: list[str]) -> DataFrame:
    """Runs a stream over all that is there now and returns the last state of each key.

    In update mode each batch hands on only the keys that it changed, and the watermark frees state. A batch writes its own folder, so one that is run again replaces it.
    """
    s = Scratch(spark)
    path = f"{s.root}/result"
    kept = change(stream)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    q = kept.writeStream.outputMode("update").option("checkpointLocation", f"{s.root}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rest = [c for c in kept.columns if c not in keys]
    every = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def folder_stream(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", at_once: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", at_once).parquet(folder)


def unprocessed(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Files that no manifest row names yet."""
    return found.join(manifest.select(key), key, "left_anti")
