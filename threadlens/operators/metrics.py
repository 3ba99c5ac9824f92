"""Scaling inside communities and per-author metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.operators.ranking import exact_percentiles
from threadlens.runtime import one_row, snapshot
from threadlens.schemas import METRIC_MEASURES, METRIC_SIDES, USER_METRICS


def community_statistics(df: DataFrame, measures: Sequence[str], by: str = "subreddit") -> DataFrame:
    """Min, max, mean and sample deviation of each measure per community.

    Aggregated with partial sums, so a community with most of the rows is no hot task,
    and written once, so that the planner knows whether it may be broadcast.
    """
    aggregates = []
    for m in measures:
        aggregates += [
            F.min(m).alias(f"{m}_min"),
            F.max(m).alias(f"{m}_max"),
            F.avg(m).alias(f"{m}_avg"),
            F.stddev_samp(m).alias(f"{m}_dev"),
        ]
    stats = df.filter(F.col(by).isNotNull()).groupBy(by).agg(*aggregates)
    return snapshot(stats, "community-statistics")


def scale_columns(
    df: DataFrame, measures: Sequence[str], typ: str = "normalization", by: str = "subreddit"
) -> DataFrame:
    """Min-max (``<m>_normalized``) or standard (``<m>_std``) scaling inside each community.

    A community with no spread, or no name, gets null.
    """
    stats = community_statistics(df, measures, by)
    joined = df.join(stats, by, "left")
    scaled = {}
    for m in measures:
        x = F.col(m).cast("double")
        if typ == "normalization":
            spread = F.col(f"{m}_max") - F.col(f"{m}_min")
            scaled[f"{m}_normalized"] = F.when(spread != 0, (x - F.col(f"{m}_min")) / spread)
        elif typ == "standardization":
            spread = F.col(f"{m}_dev")
            scaled[f"{m}_std"] = F.when(spread != 0, (x - F.col(f"{m}_avg")) / spread)
        else:
            raise ValueError("typ is 'normalization' or 'standardization'")
    return joined.withColumns(scaled).select(*df.columns, *scaled)


def _sides(flag: str) -> list[tuple[str, Column]]:
    own = F.col(flag)
    return list(zip(METRIC_SIDES, (~own, own)))


def author_metrics(scaled: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """The sixteen metrics per post author from comment-level rows with normalised measures.

    "Others' posts" are the comments other people left on the author's posts: rows are
    grouped by post author, and a per-post measure counts once per comment row. ``posts``, the table
    that ``scaled`` came from, saves joining the comments again to count communities and posts.
    """
    aggregates = []
    for measure, label in METRIC_MEASURES.items():
        x = F.col(f"{measure}_normalized")
        for side, condition in _sides("is_self_comment"):
            aggregates += [
                F.avg(F.when(condition, x)).alias(f"mean_{label}_{side}"),
                F.stddev_samp(F.when(condition, x)).alias(f"std_{label}_{side}"),
            ]
    grouped = scaled.filter(F.col("post_author").isNotNull()).groupBy("post_author").agg(*aggregates)
    return finish_metrics(grouped, participation(scaled if posts is None else posts))


def participation(df: DataFrame) -> DataFrame:
    """Distinct communities and distinct posts per author.

    Kept apart from the averages: two distinct counts multiply the rows of their
    aggregate, which is cheap for three narrow columns only.
    """
    return (
        df.filter(F.col("post_author").isNotNull())
        .groupBy("post_author")
        .agg(
            F.count_distinct("subreddit").alias("subreddits_participation"),
            F.count_distinct("post_id").alias("new_threads"),
        )
    )


def finish_metrics(grouped: DataFrame, counts: DataFrame) -> DataFrame:
    """Join the counts, min-max them over all authors, everything as double, missing as 0."""
    names = ["subreddits_participation", "new_threads"]
    counts = snapshot(counts, "participation")
    bounds = one_row(counts, **{f"{f.__name__}_{c}": f(c) for c in names for f in (F.min, F.max)})
    normalised = {}
    for c in names:
        low, high = bounds[f"min_{c}"], bounds[f"max_{c}"]
        wide = low is not None and high > low
        normalised[f"{c}_normalized"] = (F.col(c) - low) / (high - low) if wide else F.lit(0.0)
    values = grouped.join(counts, "post_author", "left").withColumns(normalised)
    return values.select("post_author", *[F.col(c).cast("double").alias(c) for c in USER_METRICS]).na.fill(
        0.0, USER_METRICS
    )


# --- the same metrics without comment-level rows ----------------------------
#
# ``post_sides`` reduces the comments of a post to a few moments per side before
# anything is scaled, so the wide rows that follow are one per post.

SIDES = ("other", "own")


def post_sides(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Posts with count, mean and squared deviation of comment scores by side.

    ``comments`` has post_id, comments_author, comments_upvote_score. The self flag
    comes from an equi-join on (post, author), which no hot post can skew; the
    reduction to one row per post has partial sums.
    """
    owners = (
        posts.filter(F.col("post_author").isNotNull())
        .select("post_id", F.col("post_author").alias("comments_author"))
        .distinct()
        .withColumn("_owner", F.lit(True))
    )
    flagged = comments.select("post_id", "comments_author", "comments_upvote_score").join(
        owners, ["post_id", "comments_author"], "left"
    )
    own = F.coalesce(F.col("_owner"), F.lit(False))
    score = F.col("comments_upvote_score").cast("double")
    aggregates = [F.min(score).alias("score_min"), F.max(score).alias("score_max")]
    for side, condition in zip(SIDES, (~own, own)):
        x = F.when(condition, score)
        aggregates += [
            F.count_if(condition).alias(f"rows_{side}"),
            F.count(x).alias(f"n_{side}"),
            F.avg(x).alias(f"mean_{side}"),
            (F.var_pop(x) * F.count(x)).alias(f"m2_{side}"),
        ]
    reduced = flagged.groupBy("post_id").agg(*aggregates)
    joined = posts.join(reduced, "post_id", "left")
    # A post without comments still counts as one row on the others' side.
    return joined.withColumns(
        {
            "rows_other": F.coalesce("rows_other", F.lit(1)),
            **{c: F.coalesce(c, F.lit(0)) for c in ("rows_own", "n_other", "n_own")},
        }
    )


def post_sides_nested(posts: DataFrame) -> DataFrame:
    """``post_sides`` from posts with comment arrays: computed in the row, no shuffle.

    Posts stored in parts are reduced part by part, then merged to one row per post.
    """
    zipped = F.arrays_zip(F.col("comments_author").alias("a"), F.col("comments_upvote_score").alias("s"))
    own = lambda c: F.coalesce(c.getField("a") == F.col("post_author"), F.lit(False))
    sides = {"other": F.filter(zipped, lambda c: ~own(c)), "own": F.filter(zipped, own)}
    out = posts.withColumns({f"_{side}": rows for side, rows in sides.items()})
    columns = {
        "score_min": F.array_min("comments_upvote_score").cast("double"),
        "score_max": F.array_max("comments_upvote_score").cast("double"),
    }
    for side in sides:
        rows = F.col(f"_{side}")
        scores = F.filter(F.transform(rows, lambda c: c.getField("s").cast("double")), lambda x: x.isNotNull())
        n = F.size(scores)
        mean = F.try_divide(F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x), n)
        columns[f"rows_{side}"] = F.size(rows)
        columns[f"n_{side}"] = n
        columns[f"mean_{side}"] = mean
        columns[f"_scores_{side}"] = scores
    out = out.withColumns(columns)

    def squared_deviation(side: str) -> Column:
        mean = F.col(f"mean_{side}")
        return F.aggregate(
            F.col(f"_scores_{side}"), F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean)
        )

    spread = {f"m2_{side}": squared_deviation(side) for side in sides}
    silent = F.coalesce(F.size("comments_author"), F.lit(0)) <= 0
    reduced = out.withColumns(
        {
            **spread,
            "rows_other": F.when(silent, 1).otherwise(F.col("rows_other")),
            **{c: F.when(silent, 0).otherwise(F.col(c)) for c in ("rows_own", "n_other", "n_own")},
        }
    ).drop("_other", "_own", "_scores_other", "_scores_own")
    return merge_parts(reduced) if "part" in posts.columns else reduced


def merge_parts(parts: DataFrame) -> DataFrame:
    """One row per post from the rows of its parts: sums, ranges and moments."""
    post = Window.partitionBy("post_id")
    whole, merged = {}, [F.min("score_min").alias("score_min"), F.max("score_max").alias("score_max")]
    for side in SIDES:
        n, mean = F.col(f"n_{side}"), F.col(f"mean_{side}")
        whole[f"_mean_{side}"] = F.try_divide(F.sum(n * mean).over(post), F.sum(n).over(post))
        away = mean - F.col(f"_mean_{side}")
        merged += [
            F.sum(f"rows_{side}").alias(f"rows_{side}"),
            F.sum(n).alias(f"n_{side}"),
            F.max(f"_mean_{side}").alias(f"mean_{side}"),
            F.sum(F.col(f"m2_{side}") + n * F.coalesce(away * away, F.lit(0.0))).alias(f"m2_{side}"),
        ]
    measures = ("score_min", "score_max", *[f"{m}_{side}" for m in ("rows", "n", "mean", "m2") for side in SIDES])
    kept = [c for c in ("post_id", "post_author", "subreddit", "comments_num", "post_upvote_ratio") if c in parts.columns]
    return parts.select(*kept, *measures).withColumns(whole).groupBy(*kept).agg(*merged)


def metrics_from_sides(sides: DataFrame) -> DataFrame:
    """Author metrics from one row per post: scale, then weighted moments per author.

    The rows are written once, after the only pass over the comments; the ranges,
    the counts and the moments each read back the few columns they need.
    """
    post_measures = ["comments_num", "post_upvote_ratio"]
    parts = [f"{p}_{s}" for p in ("rows", "n", "mean", "m2") for s in SIDES]
    sides = snapshot(
        sides.select("post_id", "post_author", "subreddit", *post_measures, "score_min", "score_max", *parts),
        "post-sides",
    )
    ranges = snapshot(
        sides.filter(F.col("subreddit").isNotNull())
        .groupBy("subreddit")
        .agg(
            *[F.min(m).alias(f"{m}_low") for m in post_measures],
            *[F.max(m).alias(f"{m}_high") for m in post_measures],
            F.min("score_min").alias("score_low"),
            F.max("score_max").alias("score_high"),
        ),
        "community-ranges",
    )
    joined = sides.filter(F.col("post_author").isNotNull()).join(ranges, "subreddit", "left")

    def spread(name: str) -> Column:
        width = (F.col(f"{name}_high") - F.col(f"{name}_low")).cast("double")
        return F.nullif(width, F.lit(0.0))

    values = {m: (F.col(m) - F.col(f"{m}_low")) / spread(m) for m in post_measures}
    for side in SIDES:
        values[f"score_{side}"] = (F.col(f"mean_{side}") - F.col("score_low")) / spread("score")
        values[f"dev_{side}"] = F.col(f"m2_{side}") / (spread("score") * spread("score"))
    scaled = joined.select(
        "post_author",
        *[F.col(f"{p}_{s}") for p in ("rows", "n") for s in SIDES],
        *[v.alias(f"y_{k}") for k, v in values.items()],
    )

    scaled = snapshot(scaled, "scaled-sides")
    cells = {}
    for side, label in zip(SIDES, METRIC_SIDES):
        for m in post_measures:
            cells[f"{METRIC_MEASURES[m]}_{label}"] = (F.col(f"y_{m}"), F.col(f"rows_{side}"), F.lit(0.0))
        cells[f"comment_upvote_score_{label}"] = (F.col(f"y_score_{side}"), F.col(f"n_{side}"), F.col(f"y_dev_{side}"))

    # Means first, then deviations from them: a difference of sums would cancel for large counts.
    sums: list[Column] = []
    for name, (y, weight, _) in cells.items():
        w = F.coalesce(F.sum(F.when(y.isNotNull(), weight)), F.lit(0))
        sums += [w.alias(f"w_{name}"), F.try_divide(F.sum(y * weight), w).alias(f"mean_{name}")]
    means = snapshot(scaled.groupBy("post_author").agg(*sums), "author-means")
    apart = scaled.join(means.select("post_author", *[f"mean_{name}" for name in cells]), "post_author")
    squares = []
    for name, (y, weight, inner) in cells.items():
        away = y - F.col(f"mean_{name}")
        squares.append(F.sum(away * away * weight + inner).alias(f"m2_{name}"))
    grouped = means.join(apart.groupBy("post_author").agg(*squares), "post_author")
    metrics: list[Column] = []
    for name in cells:
        w = F.col(f"w_{name}")
        metrics += [f"mean_{name}", F.when(w > 1, F.sqrt(F.try_divide(F.col(f"m2_{name}"), w - 1))).alias(f"std_{name}")]
    return finish_metrics(grouped.select("post_author", *metrics), participation(sides))


# --- summary ----------------------------------------------------------------

DESCRIBE_ROWS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe_exact(df: DataFrame, columns: Sequence[str] = tuple(USER_METRICS)) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max: one row per statistic."""
    simple: Mapping[str, object] = {
        "count": lambda c: F.count(c).cast("double"),
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": lambda c: F.min(c).cast("double"),
        "max": lambda c: F.max(c).cast("double"),
    }
    df = snapshot(df.select(*columns), "described")
    one = df.agg(*[f(c).alias(f"{stat}:{c}") for stat, f in simple.items() for c in columns])
    rows = one.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(stat).alias("statistic"), *[F.col(f"`{stat}:{c}`").alias(c) for c in columns])
                    for stat in simple
                ]
            )
        ).alias("r")
    ).select("r.*")
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    labelled = quartiles.select(
        "metric",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(label).alias("statistic"), F.col(f"p{i}").alias("value"))
                    for i, label in enumerate(DESCRIBE_ROWS[4:7])
                ]
            )
        ).alias("r"),
    )
    wide = labelled.groupBy("r.statistic").agg(
        *[F.max(F.when(F.col("metric") == c, F.col("r.value"))).alias(c) for c in columns]
    )
    place = F.array_position(F.array(*[F.lit(s) for s in DESCRIBE_ROWS]), F.col("statistic"))
    return rows.unionByName(wide).orderBy(place)
