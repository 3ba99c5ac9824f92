import datetime as dt

from threadlens.streaming import lasting as op
from threadlens.streaming.ingest import stream_files

SCHEMA = "post_id string, post_created_utc timestamp, n int"


def at(day):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def run(spark, folder, root, state="state"):
    from pyspark.sql.types import _parse_datatype_string

    stream = stream_files(spark, str(folder), _parse_datatype_string(SCHEMA), files_per_batch=1)
    op.append_new(stream, str(root / "out"), str(root / state), buckets=8).awaitTermination()
    return sorted(((r.post_id, r.n) for r in op.landed(spark, str(root / "out")).collect()), key=repr)


def test_ids_are_remembered_for_good_and_after_a_restart(spark, tmp_path):
    folder = tmp_path / "in"
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    add([("a", at(1), 2), ("a", at(0), 1), ("b", at(0), 3), (None, at(0), 4)])
    assert run(spark, folder, tmp_path) == sorted([("a", 1), ("b", 3), (None, 4)], key=repr)
    add([("a", at(400), 5), ("c", at(400), 6), (None, at(500), 7)])
    assert run(spark, folder, tmp_path) == sorted([("a", 1), ("b", 3), (None, 4), ("c", 6)], key=repr)
    # another checkpoint reads all files again
    assert run(spark, folder, tmp_path, "other") == sorted([("a", 1), ("b", 3), (None, 4), ("c", 6)], key=repr)
    add([("b", at(9000), 8), ("d", None, 9)])
    assert run(spark, folder, tmp_path) == sorted([("a", 1), ("b", 3), (None, 4), ("c", 6), ("d", 9)], key=repr)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    root = str(tmp_path / "out")
    first = spark.createDataFrame([("a", at(0), 1), ("b", at(0), 2)], SCHEMA)
    second = spark.createDataFrame([("b", at(1), 3), ("c", at(1), 4)], SCHEMA)
    for _ in range(2):
        op.keep_new(first, 0, root, "post_id", "post_created_utc", 4)
    for _ in range(3):
        op.keep_new(second, 1, root, "post_id", "post_created_utc", 4)
    got = lambda: sorted((r.post_id, r.n, r.of_batch) for r in op.landed(spark, root).collect())
    assert got() == [("a", 1, 0), ("b", 2, 0), ("c", 4, 1)]
    op.keep_new(spark.createDataFrame([("f", at(2), 8)], SCHEMA), 2, root, "post_id", "post_created_utc", 4)
    op.compact_seen(spark, root, "post_id")
    op.compact_seen(spark, root, "post_id")
    assert {r.of_batch for r in op.seen_ids(spark, root, "post_id", "string").select("of_batch").distinct().collect()} == {0, 2}
    op.keep_new(spark.createDataFrame([("f", at(2), 8)], SCHEMA), 2, root, "post_id", "post_created_utc", 4)
    op.keep_new(spark.createDataFrame([("a", at(2), 5), ("c", at(2), 6), ("e", at(2), 7), ("f", at(3), 9)], SCHEMA), 3, root, "post_id", "post_created_utc", 4)
    assert got() == [("a", 1, 0), ("b", 2, 0), ("c", 4, 1), ("e", 7, 3), ("f", 8, 2)]


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    root = str(tmp_path / "out")
    ids = [(f"p{i}", at(0), i) for i in range(300)]
    op.keep_new(spark.createDataFrame(ids, SCHEMA), 0, root, "post_id", "post_created_utc", 32)
    some = spark.createDataFrame([("p5", at(1), 0)], SCHEMA).select(op.bucket_of("post_id", 32).alias("b")).first().b
    found = op.seen_ids(spark, root, "post_id", "string", [some])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r.bucket for r in found.collect()} == {some}
    assert op.seen_ids(spark, root, "post_id", "string").count() == 300
    op.keep_new(spark.createDataFrame([], SCHEMA), 1, root, "post_id", "post_created_utc", 32)
    assert op.landed(spark, root).count() == 300
