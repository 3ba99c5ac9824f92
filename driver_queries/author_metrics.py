"""Scaling, author metrics and their summary."""

from pyspark.sql import functions as F

from driver_queries.adapters import COUNTED, comments, counted_posts, rounded, rounded_sql
from driver_queries.registry import query
from threadlens.operators import metrics, threads
from threadlens.plans.authors import MEASURES, user_metrics_flat
from threadlens.schemas import METRIC_MEASURES, METRIC_SIDES, USER_METRICS


def nine(df, columns):
    return df.withColumns({c: rounded(c) for c in columns})


def _metrics_sql() -> str:
    scaled = ",\n".join(
        f"""(({m} - min({m}) OVER c) / nullif(max({m}) OVER c - min({m}) OVER c, 0)) AS y_{label}"""
        for m, label in METRIC_MEASURES.items()
    )
    flags = {METRIC_SIDES[0]: "NOT is_self_comment", METRIC_SIDES[1]: "is_self_comment"}
    values = ",\n".join(
        f"""coalesce({f}(y_{label}) FILTER (WHERE {flags[side]}), 0) AS {stat}_{label}_{side}"""
        for label in METRIC_MEASURES.values()
        for stat, f in (("mean", "avg"), ("std", "stddev_samp"))
        for side in METRIC_SIDES
    )
    return f"""{COUNTED},
  scaled AS (SELECT *, {scaled} FROM rows WINDOW c AS (PARTITION BY subreddit)),
  grouped AS (
  SELECT post_author, {values},
         count(DISTINCT subreddit)::DOUBLE AS subreddits_participation,
         count(DISTINCT post_id)::DOUBLE AS new_threads
  FROM scaled WHERE post_author IS NOT NULL GROUP BY post_author),
  user_metrics AS (
  SELECT *,
    coalesce((subreddits_participation - min(subreddits_participation) OVER ())
      / nullif(max(subreddits_participation) OVER () - min(subreddits_participation) OVER (), 0), 0)
      AS subreddits_participation_normalized,
    coalesce((new_threads - min(new_threads) OVER ())
      / nullif(max(new_threads) OVER () - min(new_threads) OVER (), 0), 0) AS new_threads_normalized
  FROM grouped)"""


METRICS_SQL = _metrics_sql()
ROUNDED = ", ".join(f"{rounded_sql(c)} AS {c}" for c in USER_METRICS)


def author_table(spark, sf):
    return user_metrics_flat(counted_posts(spark, sf), comments(spark, sf))


def comment_rows(spark, sf):
    return threads.attach_comments(counted_posts(spark, sf), comments(spark, sf))


@query("user_metrics", f"WITH {METRICS_SQL} SELECT post_author, {ROUNDED} FROM user_metrics")
def user_metrics(spark, sf):
    return nine(author_table(spark, sf), USER_METRICS)


REAL_METRICS_SQL = METRICS_SQL.replace("nullif(o_custkey % 200, 0)", "o_custkey").replace("nullif(l_suppkey % 200, 0)", "l_suppkey")


@query("user_metrics_real_authors", f"WITH {REAL_METRICS_SQL} SELECT post_author, {ROUNDED} FROM user_metrics")
def user_metrics_real_authors(spark, sf):
    """As many authors as there are customers, instead of 200."""
    from driver_queries.adapters import posts, table

    written = posts(spark, sf).drop("post_author").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_custkey").alias("post_author")), "post_id")
    said = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.col("l_suppkey").alias("comments_author"), F.col("l_extendedprice").alias("comments_upvote_score"))
    counts = threads.comment_counts(said)
    counted = written.join(counts, "post_id", "left").na.fill(0, ["comments_num"])
    return nine(user_metrics_flat(counted, said), USER_METRICS)


@query("user_metrics_by_rows", f"WITH {METRICS_SQL} SELECT post_author, {ROUNDED} FROM user_metrics")
def user_metrics_by_rows(spark, sf):
    scaled = metrics.scale_columns(comment_rows(spark, sf), MEASURES)
    return nine(metrics.author_metrics(scaled, counted_posts(spark, sf)), USER_METRICS)


@query("nested_metrics", f"WITH {METRICS_SQL} SELECT post_author, {ROUNDED} FROM user_metrics")
def nested_metrics(spark, sf):
    """Posts with comment arrays, stored in parts of three comments."""
    from pyspark.sql import Window

    from driver_queries.adapters import comments, posts
    from threadlens.operators.threads import assemble_posts
    from threadlens.plans import authors

    place = F.row_number().over(Window.partitionBy("post_id").orderBy("comments_upvote_score", "comments_author")) - 1
    nested = assemble_posts(posts(spark, sf), comments(spark, sf).withColumn("comment_rank", place), per_row=3)
    return nine(authors.user_metrics(nested), USER_METRICS)


@query(
    "self_comment_rows",
    f"""WITH {COUNTED} SELECT post_id, post_author, comments_author, {rounded_sql('comments_upvote_score')} AS score,
        CASE WHEN is_self_comment THEN 'True' ELSE 'False' END AS is_self_comment FROM rows""",
)
def self_comment_rows(spark, sf):
    from threadlens.functions.posts import flag_text

    return comment_rows(spark, sf).select(
        "post_id",
        "post_author",
        "comments_author",
        rounded("comments_upvote_score").alias("score"),
        flag_text("is_self_comment").alias("is_self_comment"),
    )


@query(
    "scale_minmax",
    f"""WITH {COUNTED} SELECT post_id,
      {rounded_sql("(comments_num - min(comments_num) OVER c) / nullif(max(comments_num) OVER c - min(comments_num) OVER c, 0)")}
        AS comments_num_normalized,
      {rounded_sql("(post_upvote_ratio - min(post_upvote_ratio) OVER c) / nullif(max(post_upvote_ratio) OVER c - min(post_upvote_ratio) OVER c, 0)")}
        AS post_upvote_ratio_normalized
      FROM counted WINDOW c AS (PARTITION BY subreddit)""",
)
def scale_minmax(spark, sf):
    names = ["comments_num", "post_upvote_ratio"]
    scaled = metrics.scale_columns(counted_posts(spark, sf), names)
    out = [f"{n}_normalized" for n in names]
    return nine(scaled.select("post_id", *out), out)


@query(
    "scale_standard",
    f"""WITH {COUNTED} SELECT post_id,
      {rounded_sql("(comments_num - avg(comments_num) OVER c) / nullif(stddev_samp(comments_num) OVER c, 0)")} AS comments_num_std,
      {rounded_sql("(post_upvote_ratio - avg(post_upvote_ratio) OVER c) / nullif(stddev_samp(post_upvote_ratio) OVER c, 0)")} AS post_upvote_ratio_std
      FROM counted WINDOW c AS (PARTITION BY subreddit)""",
)
def scale_standard(spark, sf):
    names = ["comments_num", "post_upvote_ratio"]
    scaled = metrics.scale_columns(counted_posts(spark, sf), names, "standardization")
    out = [f"{n}_std" for n in names]
    return nine(scaled.select("post_id", *out), out)


def _describe_sql() -> str:
    stats = {
        "count": "count({c})::DOUBLE",
        "mean": "avg({c})",
        "std": "stddev_samp({c})",
        "min": "min({c})",
        "25%": "quantile_cont({c}, 0.25)",
        "50%": "quantile_cont({c}, 0.5)",
        "75%": "quantile_cont({c}, 0.75)",
        "max": "max({c})",
    }
    parts = []
    for stat, form in stats.items():
        values = ", ".join(f"{rounded_sql(form.format(c=c))} AS {c}" for c in USER_METRICS)
        parts.append(f"SELECT '{stat}' AS statistic, {values} FROM user_metrics")
    return f"WITH {METRICS_SQL} " + " UNION ALL ".join(parts)


@query("metrics_describe", _describe_sql())
def metrics_describe(spark, sf):
    return nine(metrics.describe_exact(author_table(spark, sf)), USER_METRICS)


@query(
    "price_percentiles",
    f"""SELECT m AS metric, {rounded_sql("quantile_cont(v, 0.25)")} AS p0, {rounded_sql("quantile_cont(v, 0.5)")} AS p1,
       {rounded_sql("quantile_cont(v, 0.9)")} AS p2, {rounded_sql("quantile_cont(v, 0.999)")} AS p3
       FROM (SELECT 'l_extendedprice' AS m, l_extendedprice AS v FROM lineitem
             UNION ALL SELECT 'l_quantity', l_quantity FROM lineitem) GROUP BY m""",
)
def price_percentiles(spark, sf):
    from driver_queries.adapters import table
    from threadlens.operators.ranking import exact_percentiles

    found = exact_percentiles(
        table(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.9, 0.999]
    )
    return nine(found, ["p0", "p1", "p2", "p3"])
