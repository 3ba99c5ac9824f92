"""Author influence per topic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions.posts import author_label, author_node_size, topic_label
from threadlens.operators.ranking import exact_percentiles, join_same, top_fraction
from threadlens.operators.topics import document_topics, term_vectors, topic_word_arrays
from threadlens.runtime import snapshot

# Weights of the score and the marker words.
PROB_WEIGHT, ACTIVITY_WEIGHT, KEYWORD_WEIGHT = 0.4, 0.3, 0.3
MARKERS = ("post", "comment")
IQR_REACH = 1.5


def text_assignments(
    model, texts: DataFrame, vocab: DataFrame, keep: Sequence[str] = ("text_id", "author", "subreddit", "text", "kind")
) -> DataFrame:
    """(text, topic, prob) of authored texts, tokenised by white space as for scoring.

    ``texts`` that already carry ``tokens`` keep them, to score as the model was trained.
    """
    texts = texts.filter(F.col("text").isNotNull())
    if "tokens" not in texts.columns:
        texts = texts.withColumn("tokens", tx.plain_tokens("text"))
    return document_topics(model, term_vectors(texts, vocab), keep)


def keyword_hits(assignments: DataFrame, words: DataFrame) -> DataFrame:
    """Number of the topic's words that occur in the text as substrings.

    The words of a topic are one short array, so the look-up is one row per assignment.
    """
    lists = snapshot(topic_word_arrays(words).select("topic_id", "words"), "topic-words")
    joined = assignments.join(lists, "topic_id", "left")
    hits = tx.bind(F.lower("text"), lambda lowered: F.size(F.filter("words", lambda w: F.contains(lowered, w))))
    return joined.withColumn("keywords", F.when(F.col("words").isNull(), 0).otherwise(hits)).drop("words")


def author_topic_contributions(
    assignments: DataFrame, words: DataFrame, count_mode: str = "marker", markers: Sequence[str] = MARKERS
) -> DataFrame:
    """Mean probability, posts, comments, communities and keyword hits per (author, topic).

    ``count_mode='marker'`` counts texts that contain the marker words, the first one
    before the second; ``'kind'`` counts by where the text came from. A deleted author
    is kept as a null author.
    """
    scored = keyword_hits(assignments, words)
    if count_mode == "marker":
        is_post = F.contains("text", F.lit(markers[0]))
        is_comment = ~is_post & F.contains("text", F.lit(markers[1]))
    elif count_mode == "kind":
        is_post, is_comment = F.col("kind") == "post", F.col("kind") == "comment"
    else:
        raise ValueError("count_mode is 'marker' or 'kind'")
    return scored.groupBy("author", "topic_id").agg(
        F.avg("prob").alias("mean_prob"),
        F.count_if(is_post).alias("posts"),
        F.count_if(is_comment).alias("comments"),
        F.count_distinct("subreddit").alias("communities"),
        F.sum("keywords").alias("keywords"),
    )


def author_communities(assignments: DataFrame) -> DataFrame:
    """Distinct (author, topic, community): the set as rows, so no author fills one task."""
    return assignments.select("author", "topic_id", "subreddit").distinct()


def influence_score(spread_bonus: float = 0.0, initiation_bonus: float = 0.0) -> Column:
    score = (
        PROB_WEIGHT * F.col("mean_prob")
        + ACTIVITY_WEIGHT * (F.col("posts") + F.col("comments"))
        + KEYWORD_WEIGHT * F.col("keywords")
    )
    if spread_bonus:
        score = score + F.when(F.col("communities") > 1, spread_bonus).otherwise(0.0)
    if initiation_bonus:
        score = score + F.when(F.col("initiated"), initiation_bonus).otherwise(0.0)
    return score


def with_initiation(contributions: DataFrame, assignments: DataFrame, created: str = "created") -> DataFrame:
    """Flag the authors whose text on a topic is its earliest."""
    mine = assignments.groupBy("author", "topic_id").agg(F.min(created).alias("_mine"))
    first = snapshot(assignments.groupBy("topic_id").agg(F.min(created).alias("_first")), "first-mention")
    flags = mine.join(first, "topic_id").select(
        "author", "topic_id", F.coalesce(F.col("_mine") == F.col("_first"), F.lit(False)).alias("initiated")
    )
    return join_same(contributions, flags, ["author", "topic_id"])


def score_authors(contributions: DataFrame, spread_bonus: float = 0.0, initiation_bonus: float = 0.0) -> DataFrame:
    return contributions.withColumn("score", influence_score(spread_bonus, initiation_bonus))


def dominant_authors(scored: DataFrame, top_percentage: float = 0.1) -> DataFrame:
    """The top fraction of authors of every topic, at least one; ties by author."""
    order = [F.desc("score"), F.asc_nulls_first("author")]
    return top_fraction(scored, top_percentage, ["topic_id"], order)


def influence_outliers(dominant: DataFrame) -> DataFrame:
    """Flag scores outside 1.5 interquartile ranges of their own topic."""
    found = exact_percentiles(dominant, ["score"], [0.25, 0.75], ["topic_id"])
    quartiles = snapshot(
        found.select("topic_id", F.col("p0").alias("q1"), F.col("p1").alias("q3")), "quartiles"
    )
    reach = IQR_REACH * (F.col("q3") - F.col("q1"))
    return join_same(dominant, quartiles, ["topic_id"]).withColumn(
        "is_outlier", (F.col("score") < F.col("q1") - reach) | (F.col("score") > F.col("q3") + reach)
    )


def without_authors(dominant: DataFrame, excluded: Sequence[str]) -> DataFrame:
    """Drop listed authors; the null author stays."""
    if not excluded:
        return dominant
    return dominant.filter(F.col("author").isNull() | ~F.col("author").isin(list(excluded)))


def author_topic_graph(
    dominant: DataFrame, words: DataFrame, exclude_authors: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) between topics and their dominant authors.

    An author of several topics is one node, labelled by the highest topic number.
    """
    kept = without_authors(influence_outliers(dominant), exclude_authors)
    name = F.concat(F.lit("Author_"), F.coalesce("author", F.lit("None")))
    topic = F.concat(F.lit("Topic_"), F.col("topic_id").cast("string"))
    edges = kept.select(topic.alias("src"), name.alias("dst"), F.col("score").alias("weight"))
    labels = topic_word_arrays(words).select("topic_id", topic_label("topic_id", "word_probs").alias("label"))
    topic_nodes = (
        kept.select("topic_id")
        .distinct()
        .join(labels, "topic_id", "left")
        .select(
            topic.alias("id"),
            "label",
            F.lit("topic").alias("type"),
            F.lit(None).cast("double").alias("size"),
            F.lit(None).cast("boolean").alias("is_outlier"),
        )
    )
    last = kept.groupBy("author").agg(
        F.max_by(F.struct("score", "is_outlier"), "topic_id").alias("_s")
    )
    author_nodes = last.select(
        name.alias("id"),
        author_label("author", "_s.score").alias("label"),
        F.lit("author").alias("type"),
        author_node_size("_s.score").alias("size"),
        F.col("_s.is_outlier").alias("is_outlier"),
    )
    return topic_nodes.unionByName(author_nodes), edges


def analyze_influence(
    model,
    texts: DataFrame,
    vocab: DataFrame,
    words: DataFrame,
    top_percentage: float = 0.1,
    count_mode: str = "marker",
) -> DataFrame:
    """Authored texts to the dominant authors of every topic."""
    assignments = text_assignments(model, texts, vocab)
    contributions = author_topic_contributions(assignments, words, count_mode)
    # The ranks below read the scores more than once.
    scored = snapshot(score_authors(contributions), "author-scores")
    return dominant_authors(scored, top_percentage)
