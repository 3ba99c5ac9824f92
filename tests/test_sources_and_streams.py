import json
from datetime import datetime

from pyspark.sql import functions as F

from threadlens.plans.collection import collect_posts
from threadlens.runtime import release_snapshots, snapshot
from threadlens.schemas import POSTS, RAW_COMMENT, RAW_SUBMISSION
from threadlens.sources import config, readers, writers
from threadlens.streaming import ingest


def post(pid, **more):
    record = {
        "subreddit": "s", "post_id": pid, "post_title": "t, \"q\"\nline", "post_author": None, "post_text": "",
        "post_title_and_text": "t ", "post_created_utc": "2019-05-26T10:00:00", "post_upvote_score": 3,
        "post_upvote_ratio": 0.5, "post_url": "u", "post_language": "en", "search_term": "x", "post_type": "link",
        "comments_bodies": ["b"], "comments_lenght": [1], "comments_author": [None], "comments_upvote_score": [2],
        "comments_created_utc": ["2019-05-26T10:00:01"], "comments_num": 1,
        "comments_graph": {pid: {"children": [f"c{pid}"], "root": True},
                           f"c{pid}": {"author": None, "id": f"c{pid}", "body": "b", "created_utc": None, "children": [], "parent_id": pid, "upvote_score": 2}},
    }
    return {**record, **more}


def test_json_array_has_maps_and_timestamps(spark, tmp_path):
    path = tmp_path / "posts"
    path.write_text(json.dumps([post("1"), post("2")]))
    df = readers.read_posts(spark, str(path), "json", array=True)
    assert df.schema == POSTS and df.count() == 2
    first = df.orderBy("post_id").first()
    assert first.post_created_utc == datetime(2019, 5, 26, 10)
    assert set(first.comments_graph) == {"1", "c1"} and first.comments_graph["1"].root is True


def test_formats_round_trip(spark, tmp_path):
    path = tmp_path / "posts"
    path.write_text(json.dumps([post("1"), post("2", post_author="u")]))
    df = readers.read_posts(spark, str(path), "json", array=True)
    want = sorted(df.collect())
    for format, options in (("parquet", {}), ("json", {}), ("csv", {})):
        out = str(tmp_path / format)
        assert writers.write_posts(df, out, format)
        again = readers.read_posts(spark, out, format, **options).select(*df.columns)
        # Empty text and null are the same in CSV.
        assert sorted(again.na.fill("", ["post_text"]).collect()) == want, format
    assert writers.write_posts(df.limit(0), str(tmp_path / "none"), "json") is False


def test_append_by_community_and_names(spark, tmp_path):
    out = str(tmp_path / "posts")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "subreddit string, post_id int")
    writers.write_posts(df, out, by_community=True, run_id="r1")
    writers.write_posts(df, out, by_community=True, run_id="r2")
    landed = spark.read.parquet(out)
    assert landed.filter("subreddit = 'a'").count() == 2 and landed.select("run_id").distinct().count() == 2
    name = writers.versioned_name("data/", "posts", "7", datetime(2024, 1, 2, 3, 4, 5))
    assert name == "data/20240102_030405_7_posts"


def test_configuration(spark, tmp_path):
    path = tmp_path / "terms.json"
    path.write_text(json.dumps({"en": ["a", "b", "a"], "it": ["c"]}))
    loaded = config.load_config(path)
    got = sorted(tuple(r) for r in config.terms_table(spark, loaded).collect())
    assert got == [("en", "a", 0, 0), ("en", "b", 0, 1), ("it", "c", 1, 0)]
    assert config.stopwords_table(spark, loaded).count() == 4


def test_graph_and_outlier_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a",)], "id string")
    edges = spark.createDataFrame([("a", "b")], "src string, dst string")
    writers.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/edges")).count() == 1
    scored = spark.createDataFrame([("u", 1.0, 2.0, 3.0, True), ("v", 0.0, 0.0, 0.0, False)], "post_author string, popularity_pc double, engagement_pc double, initiative_pc double, is_outlier boolean")
    assert writers.write_outliers(scored, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 1
    assert writers.write_outliers(scored.drop("is_outlier"), str(tmp_path / "no")) is False


def test_snapshots_are_released(spark):
    df = snapshot(spark.range(3), "three")
    assert df.count() == 3
    assert release_snapshots(spark) >= 1


def test_collection(spark, rows):
    day = 86400.0
    submissions = spark.createDataFrame(
        [
            ("a", "S", "the vote here", "x", ("u",), 1 * day, 1, 0.5, "https://i/x.png", False),
            ("b", "S", "the vote too", "x", None, 2 * day, 1, 0.5, "u", True),
            ("c", "S", "le vote", "x", ("u",), 3 * day, 1, 0.5, "u", False),
            ("d", "S", "the vote late", "x", ("u",), 400 * day, 1, 0.5, "u", False),
            ("e", "T", "the vote", "x", ("u",), 1 * day, 1, 0.5, "u", False),
        ],
        RAW_SUBMISSION,
    )
    comments = spark.createDataFrame(
        [
            ("a", "a2", 1, "t1_a1", ("w",), "le vu", 5.0, 2),
            ("a", "a1", 0, "t3_a", None, "the first", 4.0, 7),
            ("e", "e1", 0, "t3_e", ("w",), "the x", 4.0, 7),
        ],
        RAW_COMMENT,
    )
    terms = {"en": ["vote", "the"], "fr": ["vote"]}
    lists = {"en": ["the"], "fr": ["le"]}
    found = collect_posts(submissions, comments, terms, lists, exclude=["T"], start="01-01-1970", end="31-12-1970")
    got = {r.post_id: r for r in found.collect()}
    assert set(got) == {"a", "b", "c"}
    assert got["a"].post_language == "en" and got["a"].search_term == "vote" and got["a"].post_type == "image"
    assert got["a"].comments_author == [None, "w"] and got["a"].comments_num == 2
    assert got["b"].post_author is None and got["b"].post_type == "text" and got["b"].comments_bodies == []
    assert got["c"].post_language == "fr"
    strict = collect_posts(submissions, comments, terms, lists, check_comments_language=True, post_limit=1, comment_limit=1, seen=spark.createDataFrame([("e",)], "post_id string"))
    kept = {r.post_id: r.comments_bodies for r in strict.collect()}
    assert kept == {"a": ["the first"]}


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    source = str(tmp_path / "in")
    data = [(f"p{i % 30}", f"s{i % 3}", datetime(2024, 1, 1 + i % 20, i % 24)) for i in range(90)]
    df = spark.createDataFrame(data, "post_id string, subreddit string, post_created_utc timestamp")
    df.repartition(3).write.parquet(source)
    stream = ingest.stream_files(spark, source, df.schema, files_per_batch=1)
    kept = ingest.new_posts(stream, delay="365 days")
    ingest.append_to(kept, str(tmp_path / "out"), str(tmp_path / "c1"), ["subreddit"]).awaitTermination()
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.count() == 30 and landed.select("post_id").distinct().count() == 30

    counts = ingest.live_counts(ingest.stream_files(spark, source, df.schema, files_per_batch=1), ["subreddit"], width="1 day", delay="40 days")
    query = counts.writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(tuple(r) for r in df.groupBy(F.window("post_created_utc", "1 day").start.alias("w"), "subreddit").count().collect())
    got = sorted((r.window_start, r.subreddit, r.n) for r in spark.table("live").collect())
    assert got == want


def test_restart_continues_from_the_checkpoint(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "post_id string, subreddit string, post_created_utc timestamp"
    for batch in (["a", "b"], ["b", "c"]):
        rows = [(p, "s", datetime(2024, 1, 1)) for p in batch]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.stream_files(spark, source, spark.createDataFrame([], schema).schema)
        ingest.append_to(ingest.new_posts(stream), out, state).awaitTermination()
    assert sorted(r.post_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_a_join_with_configured_terms_moves_no_texts(spark):
    from pyspark.sql import functions as F

    from threadlens.sources import config

    texts = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"), F.md5(F.col("id").cast("string")).alias("text"))
    joined = texts.join(config.terms_table(spark, {"en": ["a", "b"]}), "lang")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(lang" not in plan
