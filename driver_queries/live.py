"""The stream of events through the streaming operators, against the batch answer."""

from pyspark.sql import functions as F

from driver_queries.registry import query
from threadlens.runtime import fresh_path
from threadlens.streaming import ingest


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return ingest.stream_files(spark, sf, schema, pattern="events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


def _run(spark, stream, partition_by=None):
    """Run a stream over what is there, and read what it wrote."""
    path = fresh_path(spark, "stream")
    ingest.append_to(stream, f"{path}/data", f"{path}/state", partition_by).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


@query(
    "stream_new_posts",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def stream_new_posts(spark, sf):
    """One arrival per (user, type): ids are kept for 90 days of event time, the data spans fewer."""
    keyed = _stream(spark, sf).withColumn("post_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    kept = ingest.new_posts(keyed, created="ts", delay="90 days")
    return _run(spark, kept.select("user_id", "event_type"))


@query(
    "stream_live_counts",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_live_counts(spark, sf):
    """Daily windows, open ones included: updates of every micro-batch, the last one counts."""
    counts = ingest.live_counts(_stream(spark, sf), ["event_type"], "ts", "1 day", "2 days")
    path = fresh_path(spark, "stream")
    ingest.update_to(counts, f"{path}/data", f"{path}/state").awaitTermination()
    landed = ingest.latest(spark.read.parquet(f"{path}/data"), ["window_start", "event_type"])
    return landed.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(
    "stream_by_community",
    "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1",
)
def stream_by_community(spark, sf):
    """Checkpointed append laid out per community, read back by partition."""
    landed = _run(spark, _stream(spark, sf), ["event_type"])
    return landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "stream_lasting_ids",
    """SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first FROM events GROUP BY 1, 2""",
)
def stream_lasting_ids(spark, sf):
    """One arrival per (user, type), by two runs over the same events: the second adds nothing."""
    from threadlens.streaming import lasting

    keyed = _stream(spark, sf).select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("post_id"), "user_id", "event_type", "ts")
    root = fresh_path(spark, "lasting")
    for state in ("first", "second"):  # two checkpoints: the second run sees every event as new
        lasting.append_new(_stream_again(keyed, state), root, f"{root}/{state}", order="ts", buckets=16).awaitTermination()
    return lasting.landed(spark, root).select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("first"))


def _stream_again(stream, state):
    return stream.withColumn("ts", F.col("ts") + F.expr("INTERVAL 400 DAYS")) if state == "second" else stream
