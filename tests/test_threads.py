import pytest
from pyspark.sql import functions as F

from threadlens.operators import threads

COMMENT = "post_id string, comment_id string, parent_id string, comment_rank long, comments_author string, comments_upvote_score long, body string"


@pytest.fixture
def deep(spark):
    """A chain of five replies with one side branch, an orphan and a cycle."""
    chain = [("p", f"c{i}", f"c{i - 1}" if i else "p", i, "u", 1, f"t{i}") for i in range(5)]
    extra = [
        ("p", "side", "c1", 5, "v", 1, "s"),
        ("p", "orphan", "gone", 6, "v", 1, "o"),
        ("p", "x", "y", 7, "v", 1, "x"),
        ("p", "y", "x", 8, None, 1, "y"),
    ]
    return spark.createDataFrame(chain + extra, COMMENT)


def test_levels(deep):
    got = {r.comment_id: r.level for r in threads.reply_levels(deep).collect()}
    assert got == {"c0": 0, "c1": 1, "c2": 2, "c3": 3, "c4": 4, "side": 2, "orphan": None, "x": None, "y": None}


def test_breadth_first(deep):
    levels = threads.reply_levels(deep).filter("level IS NOT NULL")
    assert [r.comment_id for r in threads.breadth_first(levels).collect()] == ["c0", "c1", "c2", "side", "c3", "c4"]


def test_tree_children_and_stub(deep, rows):
    tree = threads.comment_tree(deep)
    got = {r.comment_id: r for r in tree.collect()}
    assert got["p"].root is True and got["p"].children == ["c0"]
    assert got["c1"].children == ["c2", "side"] and got["c1"].root is None
    assert got["gone"].root is True and got["c4"].children == []


def test_long_child_lists_come_in_parts(deep):
    lists = threads.children_lists(deep, per_row=3)
    got = sorted((r.part, r.children) for r in lists.filter("parent_id = 'c1'").collect())
    assert got == [(0, ["c2"]), (1, ["side"])]


def test_edges(deep, rows):
    got = rows(threads.thread_edges(deep.filter("comment_id IN ('c0', 'c1')")))
    assert got == [("c0", "c1"), ("p", "c0"), ("p", "c1")]


def test_minimal_thread_golden(spark, rows):
    """Three posts with two, three and one comments make six edges."""
    data = [(f"post{p}", f"comment{c}", f"post{p}", c, "userA", 1, "b") for p, c in ((1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (3, 6))]
    assert threads.thread_edges(spark.createDataFrame(data, COMMENT)).count() == 6
    nodes = spark.createDataFrame(
        [("post1", "post", "userA", "positive", 4), ("post2", "post", "userB", "negative", 40), ("c", "comment", "userA", "neutral", 1), ("p", "post", "m", "unknown", 1927)],
        "id string, type string, author string, sentiment string, upvote long",
    )
    got = {r.id: (r.color, r.size) for r in threads.attributed_thread(nodes).collect()}
    assert got["post1"] == ("#1B9E77", pytest.approx(37.725887222397816))
    assert got["post2"] == ("#ec7215", pytest.approx(83.77758908227872))
    assert got["c"] == ("#97c2fc", 10.0)
    assert got["p"][1] == pytest.approx(161.27439336828732)


def test_arrays_round_trip(spark, deep, rows):
    posts = spark.createDataFrame([("p", "u", "s"), ("empty", None, "s")], "post_id string, post_author string, subreddit string")
    nested = threads.assemble_posts(posts, deep)
    got = {r.post_id: r for r in nested.collect()}
    assert got["p"].comments_bodies == ["t0", "t1", "t2", "t3", "t4", "s", "o", "x", "y"]
    assert got["p"].comments_author[-1] is None and got["p"].comments_num == 9
    assert got["empty"].comments_bodies == [] and got["empty"].comments_num == 0
    parts = threads.assemble_posts(posts, deep, per_row=4)
    assert sorted((r.comments_num, r.part, r.part_start) for r in parts.collect()) == [(0, 0, 0), (9, 0, 0), (9, 1, 4), (9, 2, 8)]
    exploded = threads.prepare_comments(nested)
    assert exploded.count() == 10
    assert exploded.filter("post_id = 'empty'").first().is_self_comment is False
    assert exploded.filter("is_self_comment").count() == 5


def test_flat_and_nested_frames_agree(spark, deep, rows):
    posts = spark.createDataFrame([("p", "u", "s"), ("empty", None, "s")], "post_id string, post_author string, subreddit string")
    flat = threads.attach_comments(posts, deep.select("post_id", "comments_author", "comments_upvote_score"))
    nested = threads.prepare_comments(threads.assemble_posts(posts, deep))
    columns = ["post_id", "comments_author", "comments_upvote_score", "is_self_comment"]
    assert rows(flat, *columns) == rows(nested, *columns)


def test_zip_stops_at_the_shorter(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", None])], "b array<string>, a array<string>")
    assert [tuple(p) for p in threads.zip_to_shorter(df, "b", "a").first().pairs] == [("a", "x"), ("b", None)]


def test_graph_from_maps_skips_stub_keeps_null_author(spark, rows):
    df = spark.sql(
        """SELECT 'p' AS post_id, 's' AS subreddit, 't' AS post_title, 'u' AS post_author, 'b' AS post_text,
        map('p', named_struct('author', CAST(NULL AS STRING), 'id', CAST(NULL AS STRING), 'body', CAST(NULL AS STRING),
              'children', array('c1'), 'parent_id', CAST(NULL AS STRING), 'root', true),
            'c1', named_struct('author', CAST(NULL AS STRING), 'id', 'c1', 'body', 'x', 'children', array('c2'), 'parent_id', 'p', 'root', CAST(NULL AS BOOLEAN)),
            'c2', named_struct('author', 'z', 'id', 'c2', 'body', 'y', 'children', array(), 'parent_id', 'c1', 'root', CAST(NULL AS BOOLEAN))
        ) AS comments_graph"""
    )
    assert rows(threads.thread_edges_from_maps(df)) == [("c1", "c2"), ("p", "c1"), ("p", "c2")]
    assert rows(threads.thread_nodes(df), "id", "type", "author") == [("c1", "comment", None), ("c2", "comment", "z"), ("p", "post", "u")]
