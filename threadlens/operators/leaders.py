"""Unusual authors: scaling, principal components, clusters, z-scores."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from threadlens.functions.posts import critical_z
from threadlens.runtime import one_row, snapshot
from threadlens.schemas import FEATURE_FAMILIES

SCORES = ["popularity_pc", "engagement_pc", "initiative_pc"]


def _moments(df: DataFrame, columns: Sequence[str]) -> dict:
    aggregates = {"n": F.count(F.lit(1))}
    for c in columns:
        aggregates[f"mean:{c}"] = F.avg(c)
        aggregates[f"dev:{c}"] = F.stddev_pop(c)
    return one_row(df, **aggregates)


def standard_scale(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """Population standard scaling over all rows; a constant column becomes 0."""
    stats = _moments(df, columns)
    scaled = {}
    for c in columns:
        deviation = stats[f"dev:{c}"]
        scaled[f"{c}{suffix}"] = (F.col(c) - stats[f"mean:{c}"]) / deviation if deviation else F.lit(0.0)
    return df.withColumns(scaled)


def _largest_sign(df: DataFrame, score: str, key: str) -> float:
    """Sign of the score of largest size; sizes are compared rounded, ties go to the last key."""
    place = F.struct(F.round(F.abs(score), 9), F.col(key))
    return one_row(df, sign=F.signum(F.max_by(score, place)))["sign"] or 0.0


def first_component(df: DataFrame, features: Sequence[str], name: str, key: str = "post_author") -> DataFrame:
    """Score on the first principal component; the row of largest size is positive.

    Without any variance the score is 0. The covariance matrix is features by features.
    """
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    model = PCA(k=1, inputCol="_features", outputCol="_pc").fit(assembled)
    scored = model.transform(assembled).withColumn("_score", vector_to_array("_pc")[0])
    sign = _largest_sign(scored, "_score", key)
    return scored.withColumn(name, F.col("_score") * sign).drop("_features", "_pc", "_score")


def first_component_of_two(df: DataFrame, first: str, second: str, name: str, key: str = "post_author") -> DataFrame:
    """Closed form for two standard-scaled features."""
    r = one_row(df, r=F.covar_pop(first, second))["r"] or 0.0
    scored = df.withColumn("_score", (F.col(first) + (-1.0 if r < 0 else 1.0) * F.col(second)) / math.sqrt(2.0))
    return scored.withColumn(name, F.col("_score") * _largest_sign(scored, "_score", key)).drop("_score")


def explained_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Share and running share of variance per component, one row per component."""
    from pyspark.ml.feature import PCA, VectorAssembler

    assembled = VectorAssembler(inputCols=list(features), outputCol="_features").transform(df)
    model = PCA(k=len(features), inputCol="_features", outputCol="_pc").fit(assembled)
    rows, total = [], 0.0
    for i, share in enumerate(model.explainedVariance.toArray().tolist()):
        total += share
        rows.append((i + 1, float(share), float(total)))
    return df.sparkSession.createDataFrame(rows, "component int, variance double, cumulative double")


def cluster_authors(df: DataFrame, k: int = 6, seed: int = 17, columns: Sequence[str] = SCORES) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    assembled = VectorAssembler(inputCols=list(columns), outputCol="_features").transform(df)
    points = assembled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(points)
    finally:
        points.unpersist()
    return model.transform(assembled).drop("_features")


def cluster_profile(df: DataFrame, columns: Sequence[str] = SCORES) -> DataFrame:
    """Size and mean scores of every cluster."""
    return df.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("members"), *[F.avg(c).alias(f"mean_{c}") for c in columns]
    )


def cluster_members(df: DataFrame, cluster: int) -> DataFrame:
    return df.filter(F.col("cluster") == cluster)


def center_distance(df: DataFrame, columns: Sequence[str] = SCORES) -> DataFrame:
    total = sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0]))
    return df.withColumn("distance_from_center", F.sqrt(total))


def farthest(df: DataFrame, n: int = 10, key: str = "post_author") -> DataFrame:
    return df.orderBy(F.desc("distance_from_center"), F.asc(key)).limit(n)


def zscore_outliers(df: DataFrame, alpha: float = 1e-6, columns: Sequence[str] = SCORES) -> DataFrame:
    """Z-scores (population deviation) and a flag for any beyond the critical value.

    A single row has z-score 0. A constant column has no z-score, and no outlier.
    """
    stats = _moments(df, columns)
    limit = critical_z(alpha)
    scores = {}
    for c in columns:
        mean, deviation = stats[f"mean:{c}"], stats[f"dev:{c}"]
        if stats["n"] <= 1:
            score = F.lit(0.0)
        else:
            score = (F.col(c) - mean) / deviation if deviation else F.lit(None).cast("double")
        scores[f"{c}_zscore"] = score
    beyond = F.lit(False)
    for z in scores:
        beyond = beyond | F.coalesce(F.abs(F.col(z)) > limit, F.lit(False))
    return df.withColumns(scores).withColumn("is_outlier", beyond)


def outliers(df: DataFrame, columns: Sequence[str] = SCORES, key: str = "post_author") -> DataFrame | None:
    """Outlying authors and their scores; None when outliers were not computed."""
    if "is_outlier" not in df.columns:
        return None
    return df.filter("is_outlier").select(key, *columns)


def split_outliers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(regular rows, outlying rows)."""
    return df.filter(~F.col("is_outlier")), df.filter("is_outlier")


def leader_scores(
    metrics: DataFrame,
    families: Mapping[str, Sequence[str]] = FEATURE_FAMILIES,
    clusters: int = 6,
    alpha: float = 1e-6,
    seed: int = 17,
) -> DataFrame:
    """Scale, project, cluster, measure and flag: the whole analysis of author metrics."""
    for name, features in families.items():
        metrics = standard_scale(metrics, features)
    # Written once per stage: every fit reads its input several times.
    metrics = snapshot(metrics, "scaled-metrics")
    names = []
    for name, features in families.items():
        metrics = first_component(metrics, features, f"{name}_pc")
        names.append(f"{name}_pc")
    metrics = snapshot(metrics, "components")
    clustered = cluster_authors(metrics, clusters, seed, names)
    return zscore_outliers(center_distance(clustered, names), alpha, names)
