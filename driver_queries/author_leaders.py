"""Scaled metrics, components, distances, z-scores, clusters."""

from pyspark.sql import functions as F

from driver_queries.author_metrics import METRICS_SQL, author_table, nine
from driver_queries.registry import query
from threadlens.functions.posts import critical_z
from threadlens.operators import leaders
from threadlens.runtime import snapshot
from threadlens.schemas import FEATURE_FAMILIES, USER_METRICS

# Three scaled metrics stand for the three component scores where SQL has to follow.
PICKED = {
    "popularity_pc": "mean_post_upvote_ratio_on_others_posts",
    "engagement_pc": "mean_comments_per_post_on_others_posts",
    "initiative_pc": "new_threads_normalized",
}
SCALED = METRICS_SQL + ", scaled_metrics AS (SELECT post_author, " + ", ".join(
    f"coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0) AS {c}" for c in USER_METRICS
) + " FROM user_metrics)"
SCORES = SCALED + ", scores AS (SELECT post_author, " + ", ".join(f"{c} AS {p}" for p, c in PICKED.items()) + " FROM scaled_metrics)"
ALPHA = 0.05


def metrics_table(spark, sf):
    """Author metrics written once; each analysis reads them several times."""
    return snapshot(author_table(spark, sf), "user-metrics")


def scaled_table(spark, sf):
    return leaders.standard_scale(metrics_table(spark, sf), USER_METRICS)


def score_table(spark, sf):
    scaled = leaders.standard_scale(metrics_table(spark, sf), list(PICKED.values()))
    return scaled.select("post_author", *[F.col(c).alias(p) for p, c in PICKED.items()])


@query(
    "standard_scale",
    f"WITH {SCALED} SELECT post_author, {', '.join(f'round({c} + 3e-11, 9) AS {c}' for c in USER_METRICS)} FROM scaled_metrics",
)
def standard_scale(spark, sf):
    return nine(scaled_table(spark, sf), USER_METRICS)


@query(
    "center_distance",
    f"""WITH {SCORES} SELECT post_author, round(sqrt(popularity_pc * popularity_pc + engagement_pc * engagement_pc
      + initiative_pc * initiative_pc) + 3e-11, 9) AS distance_from_center FROM scores""",
)
def center_distance(spark, sf):
    measured = leaders.center_distance(score_table(spark, sf))
    return nine(measured.select("post_author", "distance_from_center"), ["distance_from_center"])


@query(
    "farthest_authors",
    f"""WITH {SCORES}, d AS (SELECT post_author, sqrt(popularity_pc * popularity_pc + engagement_pc * engagement_pc
      + initiative_pc * initiative_pc) AS d FROM scores)
    SELECT post_author, round(d + 3e-11, 9) AS distance_from_center FROM d ORDER BY d DESC, post_author LIMIT 10""",
)
def farthest_authors(spark, sf):
    far = leaders.farthest(leaders.center_distance(score_table(spark, sf)))
    return nine(far.select("post_author", "distance_from_center"), ["distance_from_center"])


ZSCORES = SCORES + ", z AS (SELECT *, " + ", ".join(
    f"({p} - avg({p}) OVER ()) / nullif(stddev_pop({p}) OVER (), 0) AS {p}_zscore" for p in PICKED
) + " FROM scores)"
BEYOND = " OR ".join(f"abs({p}_zscore) > {critical_z(ALPHA)!r}" for p in PICKED)


@query(
    "zscore_outliers",
    f"WITH {ZSCORES} SELECT post_author, {', '.join(f'round({p}_zscore + 3e-11, 9) AS {p}_zscore' for p in PICKED)}, {BEYOND} AS is_outlier FROM z",
)
def zscore_outliers(spark, sf):
    flagged = leaders.zscore_outliers(score_table(spark, sf), ALPHA)
    names = [f"{p}_zscore" for p in PICKED]
    return nine(flagged.select("post_author", *names, "is_outlier"), names)


@query(
    "outlier_rows",
    f"WITH {ZSCORES} SELECT post_author, {', '.join(f'round({p} + 3e-11, 9) AS {p}' for p in PICKED)} FROM z WHERE {BEYOND}",
)
def outlier_rows(spark, sf):
    _, outlying = leaders.split_outliers(leaders.zscore_outliers(score_table(spark, sf), ALPHA))
    return nine(leaders.outliers(outlying), list(PICKED))


FIRST, SECOND = FEATURE_FAMILIES["initiative"][1], "mean_post_upvote_ratio_on_others_posts"


@query(
    "pc1_two_features",
    f"""WITH {SCALED}, s AS (
      SELECT post_author, ({FIRST} + CASE WHEN covar_pop({FIRST}, {SECOND}) OVER () < 0 THEN -1 ELSE 1 END * {SECOND}) / sqrt(2.0) AS s
      FROM scaled_metrics)
    SELECT post_author, round(s * sign((SELECT s FROM s ORDER BY round(abs(s), 9) DESC, post_author DESC LIMIT 1)) + 3e-11, 9) AS pc FROM s""",
)
def pc1_two_features(spark, sf):
    scaled = leaders.standard_scale(metrics_table(spark, sf), [FIRST, SECOND])
    return nine(leaders.first_component_of_two(scaled, FIRST, SECOND, "pc").select("post_author", "pc"), ["pc"])


@query(
    "pc1_two_by_fit",
    f"""WITH {SCALED}, s AS (
      SELECT post_author, ({FIRST} + CASE WHEN covar_pop({FIRST}, {SECOND}) OVER () < 0 THEN -1 ELSE 1 END * {SECOND}) / sqrt(2.0) AS s
      FROM scaled_metrics)
    SELECT post_author, round(s * sign((SELECT s FROM s ORDER BY round(abs(s), 9) DESC, post_author DESC LIMIT 1)) + 3e-11, 9) AS pc FROM s""",
)
def pc1_two_by_fit(spark, sf):
    """The fitted component against the closed form."""
    scaled = leaders.standard_scale(metrics_table(spark, sf), [FIRST, SECOND])
    return nine(leaders.first_component(scaled, [FIRST, SECOND], "pc").select("post_author", "pc"), ["pc"])


@query("pc1_family", f"WITH {METRICS_SQL} SELECT count(*) AS authors, true AS centred, true AS eigenvector, true AS dominant FROM user_metrics")
def pc1_family(spark, sf):
    """What makes a score the first component: C v = l v, so the covariances with the features have the length of
    the score's own variance, and no feature varies more."""
    features = FEATURE_FAMILIES["popularity"]
    scored = leaders.first_component(scaled_table(spark, sf), features, "pc")
    own = F.var_pop("pc")
    along = sum((F.pow(F.covar_pop(f, "pc"), 2) for f in features), F.lit(0.0))
    return scored.agg(
        F.count("pc").alias("authors"),
        (F.abs(F.avg("pc")) < 1e-6).alias("centred"),
        (F.abs(F.sqrt(along) - own) < 1e-6 * own).alias("eigenvector"),
        (own >= F.greatest(*[F.var_pop(f) for f in features]) - 1e-9).alias("dominant"),
    )


@query("explained_variance", "SELECT i::INT AS component, true AS falls, true AS adds_up FROM range(1, 9) t(i)")
def explained_variance(spark, sf):
    """Shares of eight components: none above the one before, running shares as they add up, one in all."""
    shares = leaders.explained_variance(scaled_table(spark, sf), FEATURE_FAMILIES["popularity"])
    pairs = shares.alias("x").join(shares.alias("y"), F.expr("y.component <= x.component"))
    grouped = pairs.groupBy("x.component", "x.variance", "x.cumulative").agg(F.sum("y.variance").alias("sum"), F.min("y.variance").alias("least"))
    last = (F.col("component") < 8) | (F.abs(F.col("cumulative") - 1) < 1e-9)
    return grouped.select(
        F.col("component").cast("int").alias("component"), (F.col("variance") <= F.col("least") + 1e-12).alias("falls"), ((F.abs(F.col("sum") - F.col("cumulative")) < 1e-9) & last).alias("adds_up")
    )


@query("author_clusters", f"WITH {METRICS_SQL} SELECT 6::BIGINT AS clusters, count(*)::BIGINT AS members FROM user_metrics")
def author_clusters(spark, sf):
    """Six clusters that hold every author once."""
    profile = leaders.cluster_profile(leaders.leader_scores(metrics_table(spark, sf)))
    return profile.agg(F.count("cluster").alias("clusters"), F.sum("members").alias("members"))


@query("leader_scores", f"WITH {METRICS_SQL} SELECT post_author, true AS distance, true AS zscores, true AS flagged, true AS clustered FROM user_metrics")
def leader_scores(spark, sf):
    """Distance, z-scores and flag of every author against their formulas over the written components."""
    scored = snapshot(leaders.leader_scores(metrics_table(spark, sf)), "scored")
    moments = scored.agg(*[f(c).alias(f"{n}:{c}") for c in PICKED for n, f in (("mean", F.avg), ("dev", F.stddev_pop))]).first().asDict()
    near = lambda a, b: F.abs(a - b) < 1e-6
    zscores, beyond = F.lit(True), F.lit(False)
    for c in PICKED:
        z = (F.col(c) - moments[f"mean:{c}"]) / moments[f"dev:{c}"]
        zscores, beyond = zscores & near(F.col(f"{c}_zscore"), z), beyond | (F.abs(z) > 4.891638475699)
    return scored.select(
        "post_author",
        near(F.col("distance_from_center"), F.sqrt(sum((F.col(c) * F.col(c) for c in PICKED), F.lit(0.0)))).alias("distance"),
        zscores.alias("zscores"),
        (F.col("is_outlier") == beyond).alias("flagged"),
        F.col("cluster").between(0, 5).alias("clustered"),
    )
