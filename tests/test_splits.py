import json
import random

import pytest
from pyspark.sql import types as T

from threadlens.sources import splits as op
from threadlens.sources.writers import CSV, write_csv

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("body", T.StringType()), T.StructField("more", T.StructType([T.StructField("a", T.ArrayType(T.StringType()))]))])
PIECES = ["a", "{", "}", "[", "]", '"', "\\", "\n", ",", "é漢😀", "},{", '"}', "\\\\", ": ", "\r\n", "'"]


@pytest.fixture
def small_splits(spark):
    """Files are cut every few hundred bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def objects(seed, n=120):
    rnd = random.Random(seed)
    text = lambda most: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most)))
    return [{"id": i, "body": None if i % 11 == 0 else text(3000 if i % 40 == 5 else 25), "more": {"a": [text(6) for _ in range(rnd.randint(0, 3))]}} for i in range(n)]


def wanted(rows):
    return sorted(((r["id"], r["body"], r["more"]["a"]) for r in rows), key=repr)


@pytest.mark.parametrize("layout", ["one line", "indented", "lines"])
def test_a_json_array_by_many_tasks(spark, tmp_path, small_splits, layout):
    some = objects(1)
    text = {"one line": json.dumps(some, ensure_ascii=False), "indented": json.dumps(some, indent=2), "lines": "\n".join(json.dumps(o) for o in some)}[layout]
    (tmp_path / "a.json").write_text(text, newline="")
    (tmp_path / "b.json").write_text(json.dumps(objects(2, 7)))
    (tmp_path / "c.json").write_text("[]")
    got = op.read_json_array(spark, str(tmp_path), SCHEMA)
    assert sorted(((r.id, r.body, r.more.a) for r in got.collect()), key=repr) == wanted(some + objects(2, 7))
    assert op.record_texts(spark, str(tmp_path / "a.json"), True).select("start").distinct().count() > 5


def test_csv_with_line_breaks_by_many_tasks(spark, tmp_path, small_splits):
    some = [{**o, "body": o["body"] or "x"} for o in objects(3)]
    df = spark.createDataFrame([(o["id"], o["body"], (o["more"]["a"],)) for o in some], SCHEMA)
    path = str(tmp_path / "posts")
    write_csv(df, path, files=1)
    got = sorted(((r.id, r.body, r.more.a) for r in op.read_csv_records(spark, path, SCHEMA).collect()), key=repr)
    flat = "id bigint, body string, more string"
    plain = spark.read.schema(flat).options(**CSV).option("multiLine", True).csv(path)
    bodies = {r.id: r.body for r in plain.collect()}
    assert [g[0] for g in got] == sorted((o["id"] for o in some), key=repr)
    assert {i: b for i, b, _ in got} == bodies
    assert [g[2] for g in got] == [w[2] for w in wanted(some)]


def test_no_records(spark, tmp_path, small_splits):
    for name, text in {"a": "[]", "b": "", "c": "\n\n", "d": "[ ]\n"}.items():
        (tmp_path / name).write_text(text)
    assert op.read_json_array(spark, str(tmp_path), SCHEMA).count() == 0
    (tmp_path / "only.csv").write_text("id,body,more\n")
    assert op.read_csv_records(spark, str(tmp_path / "only.csv"), SCHEMA).count() == 0
