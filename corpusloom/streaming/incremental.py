"""Incremental merging of catalogs with Structured Streaming, beyond the batch pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily(events: DataFrame, time: str, late: str, *by: str) -> DataFrame:
    """Counts and sums by day and group of a stream; rows later than the watermark are left out, and finished days leave the state."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), *by, "n", "total")


def first_seen(records: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark, so the state is bounded by what arrives in that time."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def merge_batches(records: DataFrame, merge: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Merges each batch into the table at path. A batch writes its own folder, so one that runs again writes the same place; the reader merges
    the folders."""

    def write(batch: DataFrame, epoch: int) -> None:
        merge(batch).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(spark: SparkSession, stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, and returns its table."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
