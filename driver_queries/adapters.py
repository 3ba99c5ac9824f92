"""The driver's tables as posts, comments, texts and threads, in Spark and in SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHORS = 200

#: Far below the ninth place and no likely fraction: exact halves there no longer hang on a sum's last bit.
NUDGE = 3e-11


def rounded(value, places: int = 9):
    """For comparing sums that engines add up in different orders."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(NUDGE), places)


def rounded_sql(value: str, places: int = 9) -> str:
    return f"round(({value}) + {NUDGE}, {places})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as posts: the nation is the community, author 0 is deleted."""
    customers = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_orderkey").alias("post_id"),
            F.col("n_name").alias("subreddit"),
            F.nullif(F.col("o_custkey") % AUTHORS, F.lit(0)).alias("post_author"),
            F.col("o_orderdate").alias("post_created_utc"),
            F.col("o_totalprice").alias("post_upvote_ratio"),
            F.col("o_orderpriority").alias("post_type"),
        )
    )


POSTS = f"""posts AS (
  SELECT o_orderkey AS post_id, n_name AS subreddit, nullif(o_custkey % {AUTHORS}, 0) AS post_author,
         o_orderdate AS post_created_utc, o_totalprice AS post_upvote_ratio, o_orderpriority AS post_type
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as comments."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("post_id"),
        F.nullif(F.col("l_suppkey") % AUTHORS, F.lit(0)).alias("comments_author"),
        F.col("l_extendedprice").alias("comments_upvote_score"),
    )


COMMENTS = f"""comments AS (
  SELECT l_orderkey AS post_id, nullif(l_suppkey % {AUTHORS}, 0) AS comments_author,
         l_extendedprice AS comments_upvote_score
  FROM lineitem)"""


def counted_posts(spark: SparkSession, sf: str) -> DataFrame:
    from threadlens.operators.threads import comment_counts

    counts = comment_counts(comments(spark, sf))
    return posts(spark, sf).join(counts, "post_id", "left").na.fill(0, ["comments_num"])


COUNTED = f"""{POSTS}, {COMMENTS}, counted AS (
  SELECT p.*, coalesce(n, 0) AS comments_num
  FROM posts p LEFT JOIN (SELECT post_id, count(*) AS n FROM comments GROUP BY 1) USING (post_id)),
  rows AS (
  SELECT p.*, c.comments_author, c.comments_upvote_score,
         coalesce(p.post_author = c.comments_author, false) AS is_self_comment
  FROM counted p LEFT JOIN comments c USING (post_id))"""


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as texts: the source is the community."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("text_id"),
        F.col("source").alias("subreddit"),
        F.col("lang").alias("post_language"),
        (F.col("doc_id") % 50).alias("author"),
        "text",
    )


TEXTS = """texts AS (
  SELECT doc_id AS text_id, source AS subreddit, lang AS post_language, doc_id % 50 AS author, text
  FROM documents)"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as threads: turn 0 is the post, turn t answers turn (t - 1) / 2."""
    turn = F.col("turn")
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    return table(spark, sf, "conversations").select(
        name(F.lit(0)).alias("post_id"),
        name(turn).alias("comment_id"),
        F.when(turn > 0, name(F.floor((turn - 1) / 2))).alias("parent_id"),
        (turn - 1).alias("comment_rank"),
        F.col("role").alias("comments_author"),
        F.length("text").cast("long").alias("comments_upvote_score"),
        F.col("text").alias("body"),
        "turn",
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).filter("turn > 0").drop("turn")


def thread_posts(spark: SparkSession, sf: str) -> DataFrame:
    return (
        messages(spark, sf)
        .filter("turn = 0")
        .select(
            "post_id",
            F.col("comments_author").alias("subreddit"),
            F.col("body").alias("post_title"),
            F.col("comments_author").alias("post_author"),
            F.col("body").alias("post_text"),
            F.col("body").alias("post_title_and_text"),
        )
    )


MESSAGES = """messages AS (
  SELECT conv_id || '-0' AS post_id, conv_id || '-' || turn AS comment_id,
         CASE WHEN turn > 0 THEN conv_id || '-' || ((turn - 1) // 2) END AS parent_id,
         turn - 1 AS comment_rank, role AS comments_author, length(text) AS comments_upvote_score,
         text AS body, turn
  FROM conversations),
  replies AS (SELECT * FROM messages WHERE turn > 0)"""
