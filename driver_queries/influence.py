"""Author influence from a fixed topic table, and from a trained model."""

from pyspark.sql import functions as F

from driver_queries.adapters import rounded, texts
from driver_queries.registry import query
from driver_queries.topic_models import SHARES, fixed_doc_topics, fixed_words
from threadlens.operators import influence
from threadlens.runtime import snapshot

MARKERS = ("que", "the")


def assignments(spark, sf):
    owned = texts(spark, sf).select("text_id", "author", "subreddit", "text")
    return fixed_doc_topics(spark, sf).join(owned, "text_id")


CONTRIBUTIONS = f"""{SHARES},
  marked AS (
  SELECT author, topic_id, prob, subreddit, text_id, contains(text, '{MARKERS[0]}') AS p,
    NOT contains(text, '{MARKERS[0]}') AND contains(text, '{MARKERS[1]}') AS c,
    (SELECT count(*) FROM words w WHERE w.topic_id = d.topic_id AND contains(lower(text), w.word)) AS k
  FROM doc_topics d JOIN texts USING (text_id)),
  contributions AS (
  SELECT author, topic_id, avg(prob) AS mean_prob, count(*) FILTER (WHERE p) AS posts,
    count(*) FILTER (WHERE c) AS comments, count(DISTINCT subreddit) AS communities, sum(k)::BIGINT AS keywords
  FROM marked GROUP BY 1, 2),
  scored AS (SELECT *, 0.4::DOUBLE * mean_prob + 0.3::DOUBLE * (posts + comments) + 0.3::DOUBLE * keywords AS score FROM contributions)"""
DOMINANT = CONTRIBUTIONS + """, dominant AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY score DESC, author) AS rank,
      count(*) OVER (PARTITION BY topic_id) AS n FROM scored)
  WHERE rank <= greatest(1, floor(0.3 * n)))"""


def contributions(spark, sf):
    found = influence.author_topic_contributions(assignments(spark, sf), fixed_words(spark), markers=MARKERS)
    return snapshot(influence.score_authors(found), "author-scores")


@query(
    "author_contributions",
    f"""WITH {CONTRIBUTIONS} SELECT author, topic_id, round(mean_prob + 3e-11, 9) AS mean_prob, posts, comments, communities,
      keywords, round(score + 3e-11, 9) AS score FROM scored""",
)
def author_contributions(spark, sf):
    return contributions(spark, sf).withColumns({"mean_prob": rounded("mean_prob"), "score": rounded("score")})


@query(
    "author_influence_fixed",
    f"WITH {DOMINANT} SELECT author, topic_id, rank, round(score + 3e-11, 9) AS score FROM dominant",
)
def author_influence_fixed(spark, sf):
    dominant = influence.dominant_authors(contributions(spark, sf), 0.3)
    return dominant.select("author", "topic_id", "rank", rounded("score").alias("score"))


OUTLIERS = DOMINANT + """, bounds AS (
  SELECT topic_id, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.75) AS q3 FROM dominant GROUP BY 1),
  flagged AS (
  SELECT d.*, q1, q3, score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1) AS is_outlier
  FROM dominant d JOIN bounds USING (topic_id))"""


@query(
    "influence_outliers",
    f"WITH {OUTLIERS} SELECT author, topic_id, round(q1 + 3e-11, 9) AS q1, round(q3 + 3e-11, 9) AS q3, is_outlier FROM flagged",
)
def influence_outliers(spark, sf):
    flagged = influence.influence_outliers(snapshot(influence.dominant_authors(contributions(spark, sf), 0.3), "dominant"))
    return flagged.select("author", "topic_id", rounded("q1").alias("q1"), rounded("q3").alias("q3"), "is_outlier")


def _author_graph(spark, sf):
    dominant = snapshot(influence.dominant_authors(contributions(spark, sf), 0.3), "dominant")
    return influence.author_topic_graph(dominant, fixed_words(spark), [7, 8])


@query(
    "author_graph_edges",
    f"""WITH {OUTLIERS} SELECT 'Topic_' || topic_id AS src, 'Author_' || author AS dst, round(score + 3e-11, 9) AS weight
    FROM flagged WHERE author NOT IN (7, 8)""",
)
def author_graph_edges(spark, sf):
    return _author_graph(spark, sf)[1].withColumn("weight", rounded("weight"))


@query(
    "author_graph_nodes",
    f"""WITH {OUTLIERS}, kept AS (SELECT * FROM flagged WHERE author NOT IN (7, 8)),
    labels AS (SELECT topic_id, 'Topic ' || (topic_id + 1) || chr(10) ||
      string_agg(word || ':' || printf('%.2f', prob), ', ' ORDER BY rank) AS label FROM words GROUP BY 1)
    SELECT 'Topic_' || topic_id AS id, label, 'topic' AS type, NULL::DOUBLE AS size, NULL::BOOLEAN AS is_outlier
    FROM labels WHERE topic_id IN (SELECT topic_id FROM kept)
    UNION ALL SELECT 'Author_' || author, author || chr(10) || '(Score: ' || printf('%.2f', arg_max(score, topic_id)) || ')',
      'author', round(round(arg_max(score, topic_id), 2) + 10, 2), arg_max(is_outlier, topic_id) FROM kept GROUP BY author""",
)
def author_graph_nodes(spark, sf):
    return _author_graph(spark, sf)[0].withColumn("size", F.round("size", 2))


@query(
    "author_communities",
    f"WITH {CONTRIBUTIONS} SELECT DISTINCT author, topic_id, subreddit FROM marked",
)
def author_communities(spark, sf):
    return influence.author_communities(assignments(spark, sf))


@query(
    "influence_bonuses",
    f"""WITH {CONTRIBUTIONS}, first AS (SELECT topic_id, min(text_id) AS f FROM marked GROUP BY 1),
    mine AS (SELECT author, topic_id, min(text_id) AS m FROM marked GROUP BY 1, 2)
    SELECT author, topic_id, m = f AS initiated,
      round(score + CASE WHEN communities > 1 THEN 10::DOUBLE ELSE 0 END + CASE WHEN m = f THEN 0.2::DOUBLE ELSE 0 END + 3e-11, 9) AS score
    FROM scored JOIN mine USING (author, topic_id) JOIN first USING (topic_id)""",
)
def influence_bonuses(spark, sf):
    rows = snapshot(assignments(spark, sf), "assignments")
    found = influence.author_topic_contributions(rows, fixed_words(spark), markers=MARKERS)
    flagged = influence.with_initiation(found, rows, "text_id")
    scored = influence.score_authors(flagged, spread_bonus=10.0, initiation_bonus=0.2)
    return scored.select("author", "topic_id", "initiated", rounded("score").alias("score"))


@query("author_influence_trained", "SELECT true AS gapless, true AS falling, true AS known")
def author_influence_trained(spark, sf):
    from driver_queries.topic_models import trained
    from threadlens.operators import topics

    model, _, vocab = trained(spark, sf)
    found = influence.analyze_influence(
        model,
        texts(spark, sf).withColumn("kind", F.lit("post")),
        vocab,
        snapshot(topics.topic_words(model, vocab), "topic-words"),
        0.2,
        count_mode="kind",
    )
    ranked = F.sort_array(F.collect_list(F.struct("rank", "score")))
    by_topic = found.groupBy("topic_id").agg(ranked.getField("rank").alias("ranks"), ranked.getField("score").alias("scores"), F.bool_and(F.col("author").between(0, 49)).alias("known"))
    return by_topic.agg(
        F.bool_and(F.transform("ranks", lambda r: r.cast("int")) == F.sequence(F.lit(1), F.size("ranks"))).alias("gapless"),
        F.bool_and(F.col("scores") == F.reverse(F.array_sort("scores"))).alias("falling"),
        F.bool_and("known").alias("known"),
    )
