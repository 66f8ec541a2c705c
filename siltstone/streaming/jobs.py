"""Streams that keep the store's counters and state. Each takes a streaming DataFrame and returns one, or starts a query
whose batches are idempotent: a batch that runs again writes the same folder again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def files(spark: SparkSession, path: str, schema, per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint holds which ones were read."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed(events: DataFrame, time: str, width: str, slide: str | None = None, late: str = "1 hour", *by: str) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows; rows later than ``late`` are dropped by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    groups = events.withWatermark(time, late).groupBy(window.alias("window"), *by)
    return groups.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    groups = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session"))
    return groups.agg(F.count("*").alias("n"))


def cooled_down(events: DataFrame, time: str, keys: list[str], span: str) -> DataFrame:
    """The first event of each key within a span; the state of a key ends with the watermark."""
    return events.withWatermark(time, span).dropDuplicatesWithinWatermark(keys)


def keep_batches(stream: DataFrame, make: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Starts a job over all that is there now: each batch's ``make`` is written under its number."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(batch: DataFrame) -> DataFrame:
    """(memory_id, n, last_at): how often a batch used each record, and when last."""
    return batch.groupBy("memory_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def counted(spark: SparkSession, out: str) -> DataFrame:
    """The counters of all batches together."""
    parts = spark.read.parquet(out)
    return parts.groupBy("memory_id").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def retried(queue: DataFrame, outcomes: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """A retry queue (id, retries) after outcomes (id, ok): what stays in it, and what is given up."""
    both = queue.join(outcomes, "id", "left")
    left = both.where("ok is null or not ok").select("id", (F.col("retries") + F.col("ok").isNotNull().cast("int")).alias("retries"))
    return left.where(F.col("retries") < most), left.where(F.col("retries") >= most)
