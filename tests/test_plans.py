"""The physical plans are the ones that hold at scale."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from threadlens.operators import selection, threads
from threadlens.operators.ranking import first_per_group, first_row

SF = os.environ.get("THREADLENS_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["user_metrics", "scale_minmax", "posts_in_windows", "term_search", "bigram_scores", "bag_of_words",
     "comment_tree", "community_drop", "influence_outliers", "zscore_outliers"],
)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in text


def test_date_ranges_and_columns_reach_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(selection.created_between(orders, "01-01-1996", "31-12-1996", "o_orderdate").select("o_orderkey"))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in text
    assert "o_totalprice" not in text
    windows = plan(selection.in_reference_windows(orders, ["15-06-1998"], "o_orderdate").select("o_orderkey", "window_date"))
    assert "GreaterThanOrEqual(o_orderdate" in windows and "Join" not in windows


def test_small_limits_are_cut_before_the_shuffle(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(first_per_group(events, 3, ["user_id"], [F.col("ts"), F.col("event_id")]))
    partial, exchange = text.index("Partial"), text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text and partial > exchange


def test_first_seen_has_partial_aggregates_and_no_window(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    text = plan(first_row(events, ["user_id"], ["ts", "event_id"]))
    assert "partial_min_by" in text and "Window" not in text


def test_a_broadcast_needs_a_small_table(spark):
    """The same look-up is broadcast below the threshold and shuffled above it."""
    query = entry.queries()["scale_minmax"]
    assert "BroadcastHashJoin [subreddit" in plan(query(spark, SF))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(query(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" not in text and "SortMergeJoin [subreddit" in text


def test_hot_post_and_hot_author_keep_every_row(spark):
    """A third of all comments on one post, by one author."""
    posts = spark.range(200).select(
        F.col("id").cast("string").alias("post_id"), F.lit("s").alias("subreddit"), (F.col("id") % 7).alias("post_author")
    )
    comments = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "5").otherwise((F.col("id") % 150).cast("string")).alias("post_id"),
        F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") % 11).alias("comments_author"),
        F.col("id").alias("comments_upvote_score"),
    )
    rows = threads.attach_comments(posts, comments)
    assert rows.filter("comments_author IS NOT NULL").count() == 3000
    assert rows.select("post_id").distinct().count() == 200
    cut = selection.limit_comment_arrays(spark.createDataFrame([([1, 2, 3],)], "a array<int>"), 2, ["a"])
    assert cut.first().a == [1, 2]


def test_collection_without_stop_words_keeps_posts(spark):
    from threadlens.plans.collection import collect_posts

    submissions = spark.createDataFrame(
        [("p", "s", "find me", "body", ("u",), 1.0, 1, 0.5, "x", True)],
        "id string, subreddit string, title string, selftext string, author struct<name:string>, created_utc double, score long, upvote_ratio double, url string, is_self boolean",
    )
    comments = spark.createDataFrame(
        [("p", "c1", 0, "t3_p", ("w",), "hello", 2.0, 3), ("p", "c2", 1, "t1_c1", None, "again", 3.0, 4)],
        "post_id string, id string, comment_rank long, parent_id string, author struct<name:string>, body string, created_utc double, score long",
    )
    row = collect_posts(submissions, comments, {"en": ["find"]}, {}).first()
    assert row.comments_num == 2 and row.comments_bodies == ["hello", "again"]
    assert row.comments_graph["p"].children == ["c1"] and row.comments_graph["c1"].children == ["c2"] and row.comments_graph["c2"].author is None


def test_texts_of_one_row_group_are_cleaned_by_many_tasks(spark):
    from driver_queries.texts import tokens

    plan = tokens(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [text_id" in plan


def test_participation_reads_no_comments(spark, monkeypatch):
    from threadlens.operators import metrics

    seen, snapshot = {}, metrics.snapshot
    monkeypatch.setattr(metrics, "snapshot", lambda df, name="table": seen.update({name: df}) or snapshot(df, name))
    entry.queries()["user_metrics_by_rows"](spark, SF)
    text = seen["participation"]._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" in text and "l_orderkey" not in text
