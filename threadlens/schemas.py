"""Explicit schemas of the tables the operators read and write."""

from pyspark.sql import types as T

COMMENT_NODE = T.StructType(
    [
        T.StructField("author", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("body", T.StringType()),
        T.StructField("created_utc", T.TimestampType()),
        T.StructField("children", T.ArrayType(T.StringType())),
        T.StructField("parent_id", T.StringType()),
        T.StructField("upvote_score", T.LongType()),
        T.StructField("root", T.BooleanType()),
    ]
)

# The comment graph is keyed by comment id, so it has to be a map: schema
# inference would make one struct field per comment id.
POSTS = T.StructType(
    [
        T.StructField("subreddit", T.StringType()),
        T.StructField("post_id", T.StringType()),
        T.StructField("post_title", T.StringType()),
        T.StructField("post_author", T.StringType()),
        T.StructField("post_text", T.StringType()),
        T.StructField("post_title_and_text", T.StringType()),
        T.StructField("post_created_utc", T.TimestampType()),
        T.StructField("post_upvote_score", T.LongType()),
        T.StructField("post_upvote_ratio", T.DoubleType()),
        T.StructField("post_url", T.StringType()),
        T.StructField("post_language", T.StringType()),
        T.StructField("search_term", T.StringType()),
        T.StructField("post_type", T.StringType()),
        T.StructField("comments_bodies", T.ArrayType(T.StringType())),
        T.StructField("comments_lenght", T.ArrayType(T.IntegerType())),
        T.StructField("comments_author", T.ArrayType(T.StringType())),
        T.StructField("comments_upvote_score", T.ArrayType(T.LongType())),
        T.StructField("comments_created_utc", T.ArrayType(T.TimestampType())),
        T.StructField("comments_num", T.IntegerType()),
        T.StructField("comments_graph", T.MapType(T.StringType(), COMMENT_NODE)),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.IntegerType()),
    ]
)

COMMUNITIES = T.StructType(
    [
        T.StructField("subreddit", T.StringType()),
        T.StructField("created_utc", T.DateType()),
        T.StructField("subscribers", T.LongType()),
        T.StructField("description", T.StringType()),
        T.StructField("over18", T.BooleanType()),
    ]
)

TERMS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("term", T.StringType()),
        T.StructField("lang_rank", T.IntegerType()),
        T.StructField("term_rank", T.IntegerType()),
    ]
)

STOPWORDS = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("word", T.StringType())]
)

# A submission as a crawler lands it, before it is flattened to POSTS.
RAW_SUBMISSION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("subreddit", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("selftext", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("score", T.LongType()),
        T.StructField("upvote_ratio", T.DoubleType()),
        T.StructField("url", T.StringType()),
        T.StructField("is_self", T.BooleanType()),
    ]
)

# A comment as a crawler lands it; comment_rank is its place in the thread listing.
RAW_COMMENT = T.StructType(
    [
        T.StructField("post_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("comment_rank", T.LongType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("author", T.StructType([T.StructField("name", T.StringType())])),
        T.StructField("body", T.StringType()),
        T.StructField("created_utc", T.DoubleType()),
        T.StructField("score", T.LongType()),
    ]
)

METRIC_SIDES = ("on_others_posts", "on_own_posts")
METRIC_MEASURES = {
    "comments_num": "comments_per_post",
    "post_upvote_ratio": "post_upvote_ratio",
    "comments_upvote_score": "comment_upvote_score",
}

USER_METRICS = (
    [
        f"{stat}_{label}_{side}"
        for label in METRIC_MEASURES.values()
        for stat in ("mean", "std")
        for side in METRIC_SIDES
    ]
    + ["subreddits_participation", "new_threads"]
    + ["subreddits_participation_normalized", "new_threads_normalized"]
)

FEATURE_FAMILIES = {
    "popularity": [c for c in USER_METRICS if "upvote" in c],
    "engagement": [c for c in USER_METRICS if "comments_per_post" in c],
    "initiative": ["subreddits_participation_normalized", "new_threads_normalized"],
}
