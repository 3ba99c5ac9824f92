"""Author metrics and leaders, from posts to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame

from threadlens.operators import leaders, metrics, threads

MEASURES = ["comments_num", "post_upvote_ratio", "comments_upvote_score"]


def user_metrics(posts: DataFrame) -> DataFrame:
    """Posts with comment arrays to metrics per author."""
    return metrics.metrics_from_sides(metrics.post_sides_nested(posts))


def user_metrics_flat(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """The same from a posts and a comments table."""
    return metrics.metrics_from_sides(metrics.post_sides(posts, comments))


def user_metrics_by_rows(posts: DataFrame) -> DataFrame:
    """The same step by step over comment-level rows: explode, scale, aggregate."""
    rows = threads.prepare_comments(posts)
    return metrics.author_metrics(metrics.scale_columns(rows, MEASURES), posts)


def find_leaders(posts: DataFrame, **settings) -> DataFrame:
    return leaders.leader_scores(user_metrics(posts), **settings)
