"""Sharding by fixed virtual slots: records hash to slots, and a stored, versioned map sends slots to shards.

Only DataFrame functions are used. Bytes are summed per slot; rebalancing edits the map: a shard keeps its
largest slots up to an equal share of all bytes, the other slots go, largest first, to the shard with the
fewest bytes. So sizes come near equal (law ``bytes``), and what stays in place is not moved. The map and
the sums have ``SLOTS`` rows whatever the input; placing slots folds over that fixed table. Places inside a
shard are counted slot by slot, so no task sees more than one slot of rows (1 / SLOTS of the data).

Defined results: null text has no bytes (size 16, CRC of nothing); null keys hash like a value; rows that
repeat key and text are spread over the slots by the number they are written with, so that a hot row fills no slot;
equal sizes go to the smaller slot, equal loads to the smaller shard; an empty table gives no rows. Other columns are
not read, so they may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions.text import bind
from threadlens.operators.ranking import join_same
from threadlens.runtime import fresh_path, path_exists, snapshot

SLOTS, SHARDS, OVERHEAD = 4096, 40, 16


def records(docs: DataFrame, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot) of every document."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    rows = snapshot(rows, "numbered")
    same = [key, "text_crc32", "size"]
    repeated = snapshot(rows.groupBy(*same).count().where("count > 1").select(*same, F.lit(True).alias("_again")), "repeated")
    told = join_same(rows, repeated, same)
    home = F.when(F.col("_again"), F.xxhash64("_at")).otherwise(F.xxhash64(F.col(key).cast("string"), "text_crc32"))
    return told.select(key, "size", "text_crc32", F.pmod(home, F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_sums(rows: DataFrame) -> DataFrame:
    """(virtual_slot, bytes, rows) of the slots in use."""
    return rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt in turn, before any bytes are known."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("virtual_slot"), (F.col("id") % shards).cast("int").alias("shard"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version to the stored map."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    stored = spark.read.schema("virtual_slot int, shard int, version int").parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def _placed(moved: Column, loads: Column) -> Column:
    """The shard of each moved slot, in order: always the one with the fewest bytes so far."""

    def place(state: Column, slot: Column) -> Column:
        def onto(shard: Column) -> Column:
            return F.struct(
                F.transform(state["loads"], lambda load, i: F.when(i == shard, load + slot["bytes"]).otherwise(load)).alias("loads"),
                F.concat(state["shards"], F.array(shard)).alias("shards"),
            )

        return bind((F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int"), onto)

    start = F.struct(loads.alias("loads"), F.array().cast("array<int>").alias("shards"))
    return F.aggregate(moved, start, place, lambda state: state["shards"])


def rebalance(slot_map: DataFrame, sums: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map for the bytes of ``sums``: moves only what equal shares ask for."""
    slots = slot_map.join(sums.select("virtual_slot", "bytes"), "virtual_slot", "left").select("version", "virtual_slot", "shard", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"))
    share = F.sum("bytes").over(Window.partitionBy("version")) / shards
    before = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot"))
    marked = slots.withColumn("share", share).withColumn("stays", (F.col("shard") < shards) & (before <= F.col("share")))
    # the whole map in one row: SLOTS entries, largest first, and the bytes that each shard keeps
    stays, entry = F.col("stays"), F.struct((-F.col("bytes")).alias("order"), "virtual_slot", "bytes")
    kept = F.collect_list(F.when(stays, F.struct("shard", "bytes")))
    row = marked.agg((F.max("version") + 1).alias("version"), F.array_sort(F.collect_list(F.when(~stays, entry))).alias("moved"), kept.alias("kept"))

    def load(number: Column) -> Column:
        return F.aggregate(F.col("kept"), F.lit(0).cast("long"), lambda total, slot: total + F.when(slot["shard"] == number, slot["bytes"]).otherwise(0))

    row = row.withColumn("loads", F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), load)).withColumn("shards", _placed(F.col("moved"), F.col("loads")))
    fresh = row.select("version", F.inline(F.arrays_zip(F.col("moved.virtual_slot").alias("virtual_slot"), F.col("shards").alias("shard"))))
    return marked.where(stays).select((F.col("version") + 1).alias("version"), "virtual_slot", "shard").unionByName(fresh)


def place(rows: DataFrame, slot_map: DataFrame, sums: DataFrame) -> DataFrame:
    """``rows`` with their shard, and their place in it: gapless from 0."""
    ahead = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sums, "virtual_slot").select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("start"))
    starts = snapshot(starts, "slot_starts")
    key = rows.columns[0]
    within = F.row_number().over(Window.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size"))
    placed = rows.withColumn("within", within).join(starts, "virtual_slot")
    return placed.withColumn("slot", (F.col("start") + F.col("within") - 1).cast("long")).drop("start", "within")


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, text: str = "text", key: str = "doc_id", map_path: str | None = None) -> DataFrame:
    """One row per document: key, size, CRC, law, shard, place in it, virtual slot and map version.

    The map is kept at ``map_path`` (else in the shared folder): version 1 is made there if it is new, and a
    further version is appended for the bytes found now.
    """
    spark = docs.sparkSession
    rows = snapshot(records(docs, text, key, slots), "records")
    sums = snapshot(slot_sums(rows), "slot_sums")
    map_path = map_path or fresh_path(spark, "slot_map")
    if not path_exists(spark, map_path):
        save_map(first_map(spark, shards, slots), map_path)
    save_map(rebalance(load_map(spark, map_path), sums, shards), map_path)
    placed = place(rows, load_map(spark, map_path), sums)
    return placed.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version")
    )
