"""Map of topics: Jensen-Shannon divergence of every two topics, and places by principal coordinates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.topics import topic_shares
from threadlens.runtime import snapshot


def topic_divergences(weights: DataFrame) -> DataFrame:
    """(a, b, divergence) of every two topics a < b from (topic_id, word, prob), in natural logarithms: 0 to ln 2.

    Probabilities are made to add up to 1 in each topic; words of weight 0 say nothing. Words only one topic
    has count by what the shared ones leave, so the join is on shared words alone.
    """
    weights = weights.where("prob > 0").groupBy("topic_id", "word").agg(F.sum("prob").alias("prob"))
    totals = weights.groupBy("topic_id").agg(F.sum("prob").alias("total"))
    shares = snapshot(weights.join(totals, "topic_id").select("topic_id", "word", (F.col("prob") / F.col("total")).alias("p")), "topic-shares")
    # topics squared: a model holds more than that
    ids = shares.agg(F.sort_array(F.collect_set("topic_id")).alias("ids"))
    rest = F.filter("ids", lambda i: i > F.col("a"))
    pairs = ids.select("ids", F.explode("ids").alias("a")).select("a", F.explode(rest).alias("b"))
    left = shares.select(F.col("topic_id").alias("a"), "word", "p")
    right = shares.select(F.col("topic_id").alias("b"), "word", F.col("p").alias("q"))
    both = left.join(right, "word").where("a < b")
    middle = (F.col("p") + F.col("q")) / 2
    gap = (F.col("p") * F.ln(F.col("p") / middle) + F.col("q") * F.ln(F.col("q") / middle)) / 2
    shared = both.groupBy("a", "b").agg(F.sum(gap).alias("gap"), (F.sum("p") + F.sum("q")).alias("mass"))
    found = F.coalesce("gap", F.lit(0.0)) + (2 - F.coalesce("mass", F.lit(0.0))) * math.log(2) / 2
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.greatest(found, F.lit(0.0)).alias("divergence"))


def principal_coordinates(distances: np.ndarray, dims: int = 2) -> np.ndarray:
    """Places (rows x dims) whose distances are as near as may be to a symmetric table; axes by falling weight.

    Squares are centred by row and column, and the largest eigenvalues span the map. The entry of an axis that is
    farthest from 0 is positive. Axes that the distances don't span are 0.
    """
    n = len(distances)
    centre = np.eye(n) - 1 / max(n, 1)
    values, vectors = np.linalg.eigh(-0.5 * centre @ distances**2 @ centre)
    order = np.argsort(-values)[:dims]
    places = vectors[:, order] * np.sqrt(np.maximum(values[order], 0))
    signs = np.array([1 if not n or column[np.argmax(np.abs(column))] >= 0 else -1 for column in places.T])
    return np.pad(places * signs, ((0, 0), (0, max(0, dims - places.shape[1]))))


def topic_map(weights: DataFrame, doc_topics: DataFrame | None = None, dims: int = 2, root: bool = False) -> DataFrame:
    """(topic_id, share, x0, x1, …): every topic's place by the divergences, or their roots, and its share of all texts.

    ``weights`` is (topic_id, word, prob); without ``doc_topics`` (topic_id, prob) shares are those of the weights.
    """
    spark = weights.sparkSession
    pairs = topic_divergences(weights).collect()  # topics squared
    topics = sorted({r.topic_id for r in weights.where("prob > 0").select("topic_id").distinct().collect()})
    at = {t: i for i, t in enumerate(topics)}
    distances = np.zeros((len(topics), len(topics)))
    for r in pairs:
        distances[at[r.a], at[r.b]] = distances[at[r.b], at[r.a]] = math.sqrt(r.divergence) if root else r.divergence
    places = principal_coordinates(distances, dims)
    rows = [(t, *map(float, place)) for t, place in zip(topics, places, strict=True)]
    kind = weights.schema["topic_id"].dataType.simpleString()
    located = spark.createDataFrame(rows, f"topic_id {kind}, " + ", ".join(f"x{i} double" for i in range(dims)))
    shares = topic_shares(weights if doc_topics is None else doc_topics).select("topic_id", "share")
    return located.join(shares, "topic_id", "left").select("topic_id", "share", *[f"x{i}" for i in range(dims)])
