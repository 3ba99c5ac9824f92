"""Incremental ingest: de-duplicate, count and append posts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    format: str = "parquet",
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.schema(schema).format(format)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def new_posts(stream: DataFrame, key: str = "post_id", created: str = "post_created_utc", delay: str = "7 days") -> DataFrame:
    """The first arrival of every id; ids are remembered for ``delay`` of event time."""
    return stream.withWatermark(created, delay).dropDuplicatesWithinWatermark([key])


def live_counts(
    stream: DataFrame,
    keys: list[str],
    created: str = "post_created_utc",
    width: str = "1 day",
    delay: str = "7 days",
) -> DataFrame:
    """Counts per key over tumbling event time; rows later than ``delay`` are dropped.

    With ``append_to`` a window comes out once, when the watermark has passed its end; with
    ``update_to`` it comes out whenever it changes, so open windows are seen as well.
    """
    counted = (
        stream.withWatermark(created, delay)
        .groupBy(F.window(created, width), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n"
    )


def append_to(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    partition_by: list[str] | None = None,
    format: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Checkpointed append, laid out per partition column."""
    writer = stream.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def update_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Checkpointed updates: each micro-batch writes the rows it changed to a folder of its own.

    A batch that is run again after a failure replaces its folder. ``latest`` reads the result.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def latest(updates: DataFrame, keys: list[str], batch: str = "batch") -> DataFrame:
    """The last written row of every key."""
    others = [c for c in updates.columns if c not in (*keys, batch)]
    last = F.max_by(F.struct(*others), F.col(batch)).alias("_row")
    return updates.groupBy(*keys).agg(last).select(*keys, "_row.*")
