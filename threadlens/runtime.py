"""Session defaults and the shared folder for intermediate tables.

``snapshot`` is how the library cuts lineage and how it sizes broadcasts. The
frame is written once as Parquet under ``spark.checkpoint.dir`` and read back, so

* a lost executor costs a re-read, not a recomputation;
* several consumers share one computation, each reading only its own columns;
* the planner knows the true size of the table: a join with it is broadcast when
  it is below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled (with AQE
  splitting hot keys) when it is not. No operator forces a broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

_written: list[str] = []


def session(app_name: str = "threadlens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **{key.replace("__", "."): str(value) for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor has to reach.

    Local sessions without the setting, as in tests, use a folder of their own under the warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/_snapshots/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/threadlens/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete one path given by ``fresh_path``, when nothing reads it any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    if path in _written:
        _written.remove(path)


def written(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """Like ``snapshot``, with the path, for tables that are dropped before the result is read."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def snapshot(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and return the frame that reads it."""
    return written(df, name)[0]


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query go as it ends, not when the driver happens to collect its garbage.

    For steps that write all they make: a frame that is computed inside is not to be read again outside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def one_row(df: DataFrame, **aggregates: Column) -> dict:
    """A few global aggregates as plain values: one row crosses to the driver.

    Used instead of a cross join with a one-row frame or an unpartitioned window.
    """
    return df.agg(*[value.alias(name) for name, value in aggregates.items()]).first().asDict()


def release_snapshots(spark: SparkSession) -> int:
    """Delete every snapshot of this process; call it when no result is still being read."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(path.getFileSystem(conf).delete(path, True))
    return count
