import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from threadlens.operators import leaders, metrics, threads
from threadlens.plans import authors
from threadlens.schemas import METRIC_MEASURES, USER_METRICS

NESTED = """subreddit string, post_id string, post_author string, comments_num int, post_upvote_ratio double,
comments_author array<string>, comments_upvote_score array<long>, comments_bodies array<string>"""


def nested_posts():
    return [
        ("s1", "a", "u", 3, 0.5, ["u", "v", None], [5, 1, 9], ["", "", ""]),
        ("s1", "b", "u", 2, 0.9, ["w", "u"], [2, None], ["", ""]),
        ("s1", "c", "v", 0, 0.7, [], [], []),
        ("s2", "d", "v", 1, 0.4, ["u"], [4], [""]),
        ("s2", "e", "u", 1, 0.4, ["u"], [4], [""]),
        (None, "f", "u", 1, 0.4, ["u"], [4], [""]),
        ("s1", "g", None, 1, 0.1, ["x"], [100], [""]),
        ("s3", "h", "z", 0, 0.2, [], [], []),
    ]


def reference_metrics(data):
    """The metrics by their definition, in plain pandas."""
    rows = []
    for sub, pid, author, num, ratio, who, scores, _ in data:
        for a, s in list(zip(who, scores)) or [(None, None)]:
            rows.append((sub, pid, author, num, ratio, s, author is not None and author == a))
    df = pd.DataFrame(rows, columns=["subreddit", "post_id", "post_author", *METRIC_MEASURES, "own"])
    for m in METRIC_MEASURES:
        df[m] = df[m].astype(float)
        g = df.groupby("subreddit")[m]
        low, high = g.transform("min"), g.transform("max")
        df[m] = ((df[m] - low) / (high - low)).where(high != low)
    out = {}
    for author, part in df.groupby("post_author"):
        row = {}
        for m, label in METRIC_MEASURES.items():
            for own, side in ((False, "on_others_posts"), (True, "on_own_posts")):
                x = part.loc[part.own == own, m]
                row[f"mean_{label}_{side}"] = x.mean()
                row[f"std_{label}_{side}"] = x.std()
        row["subreddits_participation"] = part.subreddit.nunique()
        row["new_threads"] = part.post_id.nunique()
        out[author] = row
    table = pd.DataFrame(out).T
    for c in ("subreddits_participation", "new_threads"):
        table[f"{c}_normalized"] = (table[c] - table[c].min()) / (table[c].max() - table[c].min())
    return table.astype(float).fillna(0.0)[USER_METRICS]


def check(df, want):
    got = {r.post_author: r for r in df.collect()}
    assert set(got) == set(want.index)
    assert df.columns == ["post_author", *USER_METRICS]
    for author, row in want.iterrows():
        for c in USER_METRICS:
            assert got[author][c] == pytest.approx(row[c], abs=1e-7), (author, c)


def test_nested_metrics(spark):
    df = spark.createDataFrame(nested_posts(), NESTED)
    check(authors.user_metrics(df), reference_metrics(nested_posts()))


def test_metrics_by_rows(spark):
    df = spark.createDataFrame(nested_posts(), NESTED)
    check(authors.user_metrics_by_rows(df), reference_metrics(nested_posts()))


def test_flat_metrics(spark):
    df = spark.createDataFrame(nested_posts(), NESTED)
    comments = df.select("post_id", F.explode(F.arrays_zip("comments_author", "comments_upvote_score")).alias("c")).select("post_id", "c.*")
    posts = df.drop("comments_author", "comments_upvote_score", "comments_bodies")
    check(authors.user_metrics_flat(posts, comments), reference_metrics(nested_posts()))


def test_metrics_without_any_self_comment(spark):
    data = [("s", "a", "u", 1, 0.5, ["v"], [1], [""]), ("s", "b", "w", 2, 0.9, ["v", "v"], [3, 5], ["", ""])]
    df = authors.user_metrics(spark.createDataFrame(data, NESTED))
    for r in df.collect():
        assert all(r[c] == 0.0 for c in USER_METRICS if c.endswith("own_posts"))
        assert r.new_threads == 1.0 and r.new_threads_normalized == 0.0


def test_scaling_flat_and_single_groups(spark, rows):
    df = spark.createDataFrame(
        [("flat", 1, 5.0), ("flat", 2, 5.0), ("one", 3, 1.0), ("two", 4, 1.0), ("two", 5, 3.0), (None, 6, 9.0)],
        "subreddit string, id int, x double",
    )
    scaled = metrics.scale_columns(df, ["x"])
    assert rows(scaled, "id", "x_normalized") == [(1, None), (2, None), (3, None), (4, 0.0), (5, 1.0), (6, None)]
    standard = {r.id: r.x_std for r in metrics.scale_columns(df, ["x"], "standardization").collect()}
    assert standard[1] is None and standard[3] is None and standard[6] is None
    assert standard[5] == pytest.approx(1 / math.sqrt(2))
    with pytest.raises(ValueError):
        metrics.scale_columns(df, ["x"], "other")


def test_describe_matches_pandas(spark):
    data = [(float(i % 7), float(i * i % 11)) for i in range(53)]
    got = metrics.describe_exact(spark.createDataFrame(data, "x double, y double"), ["x", "y"]).collect()
    want = pd.DataFrame(data, columns=["x", "y"]).describe()
    assert [r.statistic for r in got] == list(want.index)
    for r in got:
        assert (r.x, r.y) == pytest.approx(tuple(want.loc[r.statistic]))


def test_metric_names_and_order():
    assert len(USER_METRICS) == 16
    assert USER_METRICS[0] == "mean_comments_per_post_on_others_posts"
    assert USER_METRICS[3] == "std_comments_per_post_on_own_posts"


def test_standard_scale_and_zscores(spark):
    df = spark.createDataFrame([(i, float(i), 3.0, float(-i)) for i in range(50)], "post_author int, a double, b double, c double")
    scaled = leaders.standard_scale(df, ["a", "b"])
    stats = scaled.agg(F.avg("a"), F.stddev_pop("a"), F.max("b")).first()
    assert stats[0] == pytest.approx(0) and stats[1] == pytest.approx(1) and stats[2] == 0.0
    one = leaders.zscore_outliers(df.limit(1), columns=["a", "b", "c"]).first()
    assert one.a_zscore == 0.0 and one.is_outlier is False
    flagged = leaders.zscore_outliers(df, 0.2, ["a", "b", "c"])
    assert flagged.filter("is_outlier").count() > 0 and flagged.filter("b_zscore IS NOT NULL").count() == 0


def test_first_component_matches_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    x = (x - x.mean(0)) / x.std(0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "post_author int, a double, b double, c double, d double")
    got = np.array([r.pc for r in leaders.first_component(df, ["a", "b", "c", "d"], "pc").orderBy("post_author").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, 0] * s[0]
    want = want * np.sign(want[np.argmax(np.abs(want))])
    assert np.allclose(got, want)
    shares = leaders.explained_variance(df, ["a", "b", "c", "d"]).collect()
    assert shares[-1].cumulative == pytest.approx(1.0) and shares[0].variance == pytest.approx(s[0] ** 2 / (s**2).sum())


def test_leader_pipeline(spark):
    data = [(f"u{i}", *[float((i * (k + 3)) % 17) for k in range(len(USER_METRICS))]) for i in range(40)]
    schema = "post_author string, " + ", ".join(f"{c} double" for c in USER_METRICS)
    scored = leaders.leader_scores(spark.createDataFrame(data, schema), clusters=3)
    assert scored.count() == 40
    profile = leaders.cluster_profile(scored).collect()
    assert len(profile) == 3 and sum(r.members for r in profile) == 40
    regular, outlying = leaders.split_outliers(scored)
    assert regular.count() + outlying.count() == 40
    assert leaders.outliers(scored.drop("is_outlier")) is None
    assert leaders.farthest(scored, 5).count() == 5


def test_equal_values_have_no_spread(spark):
    """Deviations from the mean, not a difference of large sums."""
    posts = spark.range(100_000).select(
        F.lit("s").alias("subreddit"), F.col("id").cast("string").alias("post_id"), F.when(F.col("id") < 2, "other").otherwise("u").alias("post_author"),
        F.when(F.col("id") == 0, 7).otherwise(3).alias("comments_num"), F.when(F.col("id") == 1, 0.9).otherwise(0.1).alias("post_upvote_ratio"),
        F.array(F.lit("w")).alias("comments_author"), F.array(F.col("id") % 2).alias("comments_upvote_score"),
    )
    row = authors.user_metrics(posts).where("post_author = 'u'").first()
    assert row["std_comments_per_post_on_others_posts"] < 1e-12 and row["std_post_upvote_ratio_on_others_posts"] < 1e-12
    assert abs(row["std_comment_upvote_score_on_others_posts"] - 0.5) < 1e-4


def test_posts_in_parts_give_the_same_metrics(spark):
    comments = spark.createDataFrame(
        [(p, i, "u" if (i + len(p)) % 3 else "v", float(i * i % 7)) for p, n in (("a", 11), ("bb", 4), ("ccc", 1)) for i in range(n)],
        "post_id string, comment_rank long, comments_author string, comments_upvote_score double",
    )
    posts = spark.createDataFrame([("a", "u", "s", 0.5), ("bb", "v", "s", 0.2), ("ccc", "u", "t", 0.9), ("d", "u", "s", 0.1)], "post_id string, post_author string, subreddit string, post_upvote_ratio double")
    whole, parts = (
        {r.post_author: [round(r[c], 9) for c in USER_METRICS] for r in authors.user_metrics(threads.assemble_posts(posts, comments, per_row=n)).collect()} for n in (10_000, 3)
    )
    assert whole == parts and len(whole) == 2
