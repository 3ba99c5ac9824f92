from datetime import datetime

import pytest
from pyspark.sql import functions as F

from threadlens.functions import posts as px
from threadlens.operators import selection as sel
from threadlens.operators.ranking import exact_percentiles, first_per_group, rank_rows, top_fraction


def test_post_types_first_match_wins(spark, rows):
    urls = [
        (1, True, "https://a/x.jpg", "text"),
        (2, False, "https://a/x.jpg", "image"),
        (3, False, "https://a/x.gifv", "gifv"),
        (4, False, "https://a/x.JPG", "link"),
        (5, False, "https://v.redd.it/abc", "video"),
        (6, False, "https://a/x.mp4", "video"),
        (7, False, "https://www.reddit.com/gallery/abc", "gallery"),
        (8, False, "https://a/x", "link"),
        (9, False, "https://v.redd.it/x.png", "image"),
    ]
    df = spark.createDataFrame(urls, "id int, is_self boolean, url string, wanted string")
    assert df.filter(px.post_type("is_self", "url") != F.col("wanted")).count() == 0


def test_dates_and_text(spark):
    df = spark.createDataFrame([("a", None, "31-12-2020", 0.0), ("a", "b", "2020-12-31", None)], "t string, x string, d string, s double")
    got = df.select(
        px.combine_text("t", "x").alias("safe"),
        px.combine_text("t", "x", null_safe=False).alias("strict"),
        px.parse_day("d").alias("day"),
        px.epoch_to_iso("s").alias("iso"),
    ).collect()
    assert [r.safe for r in got] == ["a ", "a b"]
    assert [r.strict for r in got] == [None, "a b"]
    assert got[0].day == datetime(2020, 12, 31) and got[1].day is None
    assert got[0].iso == "1970-01-01T00:00:00" and got[1].iso is None
    with pytest.raises(Exception):
        df.select(px.parse_day("d", strict=True)).collect()


def test_language_names(spark):
    assert px.language_name("it") == "italian"
    with pytest.raises(ValueError):
        px.language_name("xx")
    df = spark.createDataFrame([("sl",)], "c string")
    assert df.select(px.language_name_column("c")).first()[0] == "slovene"
    with pytest.raises(Exception):
        spark.createDataFrame([("xx",)], "c string").select(px.language_name_column("c")).collect()


def test_critical_value():
    assert px.critical_z() == pytest.approx(4.891638475699, abs=1e-9)


def test_windows_overlap_and_bounds(spark, rows):
    dates = ["25-05-2014", "26-05-2018"]
    w = sel.reference_windows(dates)
    moments = [(1, w[0]["lo"]), (2, w[0]["hi"]), (3, w[1]["lo"]), (4, datetime(2000, 1, 1)), (5, None)]
    df = spark.createDataFrame(moments, "post_id int, post_created_utc timestamp")
    got = rows(sel.in_reference_windows(df, dates), "post_id", "window_date")
    assert got == [(1, dates[0]), (2, dates[0]), (2, dates[1]), (3, dates[0]), (3, dates[1])]
    assert w[0]["lo"] == datetime(2011, 11, 24, 12)
    with pytest.raises(ValueError):
        sel.reference_windows(["2014-05-25"])


def test_communities(spark, rows):
    counts = spark.createDataFrame([("b", 3, 0), ("a", 3, 1), ("C", 1, 2), (None, 9, 3)], "subreddit string, n long, discovery_rank int")
    named = counts.filter("subreddit IS NOT NULL")
    assert [r.subreddit for r in sel.top_communities(named, 2).collect()] == ["a", "b"]
    assert rows(sel.communities_to_search(named, 1, ["b"]), "subreddit") == [("a",)]
    assert rows(sel.exclude_communities(named, ["c"]), "subreddit") == [("C",), ("a",), ("b",)]
    assert rows(sel.exclude_communities(named, ["c"], ignore_case=True), "subreddit") == [("a",), ("b",)]
    details = spark.createDataFrame([("a", 5), ("C", 7), ("z", 9)], "subreddit string, subscribers long")
    kept, restricted = sel.filter_communities(named, details, names=["a", "z"])
    assert rows(kept, "subreddit") == [("a",)] and rows(restricted, "subreddit") == [("a",)]
    for bad in ({}, {"top_n": 1, "names": ["a"]}):
        with pytest.raises(ValueError):
            sel.filter_communities(named, details, **bad)
    gone = spark.createDataFrame([("C",), ("z",)], "subreddit string")
    assert rows(sel.drop_communities(details, gone, gone), "subreddit") == [("a",)]
    assert [r.subreddit for r in sel.by_subscribers(details).collect()] == ["z", "C", "a"]
    posts = spark.createDataFrame([("a", "link"), ("a", "text"), ("q", "link")], "subreddit string, post_type string")
    assert rows(sel.add_post_counts(details, posts), "subreddit", "total_counter") == [("C", 0), ("a", 2), ("z", 0)]
    assert rows(sel.add_type_counts(details, posts), "subreddit", "link", "text", "image") == [
        ("C", 0, 0, 0),
        ("a", 1, 1, 0),
        ("z", 0, 0, 0),
    ]


def test_search_and_first_seen(spark, rows):
    df = spark.createDataFrame(
        [("p1", "EU Election now", None, ["nothing"]), ("p2", "x", "y", ["an ELEZIONE"]), ("p3", "x", None, None)],
        "id string, title string, text string, bodies array<string>",
    )
    terms = {"it": ["elezione", "now"], "en": ["eu election", "eu election"]}
    hits = sel.search_terms(df, terms, ["title", "text"], ["bodies"])
    assert rows(hits, "id", "lang", "term") == [("p1", "en", "eu election"), ("p1", "it", "now"), ("p2", "it", "elezione")]
    first = sel.first_seen(hits.drop("bodies"), ["lang_rank", "term_rank"], "id")
    assert rows(first, "id", "term") == [("p1", "now"), ("p2", "elezione")]
    seen = spark.createDataFrame([("p1",)], "id string")
    assert rows(sel.unseen_posts(first, seen, "id"), "id") == [("p2",)]


def test_deleted_authors(spark, rows):
    df = spark.createDataFrame([("a", "b"), (None, "b"), ("a", "[deleted]")], "post_author string, comments_author string")
    assert rows(sel.drop_deleted(df)) == [("a", "b")]


def test_ranks_of_one_hot_group_match_a_sort(spark):
    data = [("hot" if i % 10 else "cold", (i * 7919) % 1000, i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, v int, id int")
    got = {r.id: r.rank for r in rank_rows(df, [F.desc("v"), F.asc("id")], ["g"]).collect()}
    want = {}
    for g in ("hot", "cold"):
        ordered = sorted((x for x in data if x[0] == g), key=lambda x: (-x[1], x[2]))
        want.update({x[2]: i + 1 for i, x in enumerate(ordered)})
    assert got == want


def test_limits_small_and_large_agree(spark, rows):
    df = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    large = first_per_group(df, 1200, ["g"], [F.col("id")])
    assert large.count() == 2400 and large.agg(F.max("id")).first()[0] == 2399
    assert rows(first_per_group(df, 1, ["g"], [F.col("id")])) == [(0, 0), (1, 1)]


def test_top_fraction_keeps_at_least_one(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(10)] + [("b", 1), (None, 5)], "g string, v int")
    got = rows(top_fraction(df, 0.35, ["g"], [F.desc("v")]), "g", "v")
    assert sorted(got, key=repr) == sorted([("a", 9), ("a", 8), ("a", 7), ("b", 1), (None, 5)], key=repr)


def test_exact_percentiles_match_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = {"x": rng.integers(0, 50, 400).astype(float), "y": rng.normal(size=400)}
    df = spark.createDataFrame(list(zip(values["x"].tolist(), values["y"].tolist())), "x double, y double")
    for r in exact_percentiles(df, ["x", "y"], [0.0, 0.25, 0.333, 1.0]).collect():
        want = np.percentile(values[r.metric], [0, 25, 33.3, 100])
        assert [r.p0, r.p1, r.p2, r.p3] == pytest.approx(list(want))
