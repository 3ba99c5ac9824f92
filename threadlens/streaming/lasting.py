"""Streams whose ids are remembered for good.

Every micro-batch is held against a table of the ids seen so far, laid out by bucket of the id, so a batch reads only
the buckets its own ids fall in. What a batch writes carries its run (the checkpoint) and number: one that is run again
after a failure ignores what it left before and replaces it, and a new checkpoint goes on with the ids of the old ones.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadlens.operators.ranking import join_same
from threadlens.runtime import drop_path, path_exists, snapshot

#: Buckets of the seen table, and the run that compacted ids go by.
BUCKETS, COMPACT = 256, "compact"


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def seen_ids(spark: SparkSession, root: str, key: str, kind: str, buckets: list[int] | None = None) -> DataFrame:
    """(key, of_run, of_batch, bucket) of the ids seen, of some buckets only if asked; folders of other buckets are not read."""
    schema = f"`{key}` {kind}, of_run string, of_batch long, bucket int"
    if not path_exists(spark, f"{root}/seen"):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("basePath", f"{root}/seen").parquet(f"{root}/seen")
    return found if buckets is None else found.where(F.col("bucket").isin(buckets))


def keep_new(batch: DataFrame, number: int, root: str, key: str, order: str, buckets: int = BUCKETS, run: str = "main") -> None:
    """Write the first row, by ``order``, of every id of a batch that no earlier batch had; null is an id."""
    spark = batch.sparkSession
    held = snapshot(batch.withColumn("_bucket", bucket_of(key, buckets)), "micro-batch")
    touched = [r["_bucket"] for r in held.select("_bucket").distinct().collect()]  # at most the buckets
    others = [c for c in batch.columns if c != key]
    first = held.groupBy(key, "_bucket").agg(F.min_by(F.struct(*others), F.struct(order, F.xxhash64(*others))).alias("_row"))
    kind = batch.schema[key].dataType.simpleString()
    earlier = seen_ids(spark, root, key, kind, touched).where((F.col("of_run") != run) | (F.col("of_batch") < number))
    new = join_same(first, earlier.select(key, F.lit(True).alias("_known")).distinct(), [key]).where("_known is null")
    rows = snapshot(new.select(key, F.col("_bucket").alias("bucket"), "_row"), "new-rows")
    rows.select(key, "_row.*").select(*batch.columns).write.mode("overwrite").parquet(f"{root}/posts/of_run={run}/of_batch={number}")
    rows.select(key, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/seen/of_run={run}/of_batch={number}")
    for frame in (held, rows):
        for path in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            drop_path(spark, path)


def append_new(
    stream: DataFrame, root: str, checkpoint: str, key: str = "post_id", order: str = "post_created_utc", buckets: int = BUCKETS, available_now: bool = True
) -> StreamingQuery:
    """The first arrival of every id, ever, below ``root``; ``landed`` reads it."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    writer = writer.foreachBatch(lambda batch, number: keep_new(batch, number, root, key, order, buckets, run))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def landed(spark: SparkSession, root: str) -> DataFrame:
    """Rows that ``append_new`` kept, with the run and batch that brought them."""
    return spark.read.option("basePath", f"{root}/posts").parquet(f"{root}/posts")


def compact_seen(spark: SparkSession, root: str, key: str, kind: str = "string") -> None:
    """Put the ids of all batches but each run's last together, a file a bucket; call it when no batch is running."""
    ids = seen_ids(spark, root, key, kind)
    folders = sorted((r.of_run, r.of_batch) for r in ids.select("of_run", "of_batch").distinct().collect())
    last = dict(folders)
    # a run's last batch may be run again and replaced; the others go to a new folder, then theirs go
    old = [f for f in folders if f[0] == COMPACT or f[1] < last[f[0]]]
    if len(old) < 2:
        return
    named = F.concat_ws("/", "of_run", F.col("of_batch").cast("string"))
    merged = ids.where(named.isin([f"{run}/{number}" for run, number in old])).select(key, "bucket").distinct()
    merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/seen/of_run={COMPACT}/of_batch={last.get(COMPACT, -1) + 1}")
    for run, number in old:
        drop_path(spark, f"{root}/seen/of_run={run}/of_batch={number}")
