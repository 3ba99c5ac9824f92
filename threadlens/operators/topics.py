"""Topic models and the tables read off them."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators.ranking import first_row, rank_rows
from threadlens.operators.threads import is_first_part
from threadlens.operators.topic_model import BAG, TopicModel, bag_column, train
from threadlens.runtime import one_row

# Training defaults and the smallest probability reported.
NUM_TOPICS = 10
CHUNK_SIZE = 100
PASSES = 10
SEED = 17
MIN_PROBABILITY = 0.01
#: Terms a topic model can have: topics x terms are held on the driver and in each task.
MAX_TERMS = 1_000_000


def vocabulary_terms(vocab: DataFrame) -> list[str]:
    """Terms by id on the driver, where the model itself holds topics x terms.

    The vocabulary's ``keep_n`` bounds them; one of more than ``MAX_TERMS`` terms is refused.
    """
    rows = vocab.select("term_id", "term").orderBy("term_id").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"a topic model takes {MAX_TERMS} terms at most; cut the vocabulary with keep_n")
    return [r.term for r in rows]


def term_vectors(texts: DataFrame, vocab: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Adds ``bag``, the (term_id, cnt) of every text; the look-up runs inside each task and moves nothing."""
    return texts.withColumn("bag", bag_column(vocabulary_terms(vocab), tokens))


def train_topics(
    vectors: DataFrame,
    num_topics: int = NUM_TOPICS,
    passes: int = PASSES,
    chunk_size: float = CHUNK_SIZE,
    learn_alpha: bool = True,
    alpha: float | Sequence[float] | None = None,
    online: bool = True,
    seed: int = SEED,
    num_terms: int | None = None,
) -> TopicModel:
    """Online variational topic model over bags.

    ``passes * ceil(N / chunk_size)`` updates, each of which reads the texts of its chunk only; a ``chunk_size``
    below 1 is a share of the corpus. ``alpha`` is a prior for all topics or one per topic; without it the start
    is 1 / topics. ``learn_alpha`` updates it. ``num_terms`` is the size of the vocabulary, if more than the texts use.
    """
    return train(vectors, num_topics, passes, chunk_size, num_terms, learn_alpha, alpha, online, seed)


def document_topics(
    model: TopicModel, vectors: DataFrame, keep: Sequence[str] = ("text_id",), min_probability: float = MIN_PROBABILITY
) -> DataFrame:
    """(…, topic_id, prob) per text, small probabilities dropped.

    A text without a vocabulary word gets the normalised prior.
    """
    scored = vectors.select(*keep, model.topic_shares("bag").alias("_probs"))
    rows = scored.select(*keep, F.posexplode("_probs").alias("topic_id", "prob"))
    return above_minimum(rows, min_probability)


def above_minimum(doc_topics: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    return doc_topics.filter(F.col("prob") >= min_probability)


def topic_words(model: TopicModel, vocab: DataFrame, num_words: int = 10) -> DataFrame:
    """(topic_id, word, prob, rank) of the ``num_words`` heaviest words of each topic."""
    shares = model.word_shares()
    rows = []
    for topic, row in enumerate(shares):
        # equal weights at the edge all take part, and are ranked by word
        edge = np.partition(row, len(row) - num_words)[len(row) - num_words] if 0 < num_words < len(row) else 0.0
        rows += [(topic, int(i), float(row[i])) for i in np.flatnonzero(row >= edge)]
    heaviest = vocab.sparkSession.createDataFrame(rows, "topic_id int, term_id int, prob double")
    named = heaviest.join(vocab.select("term_id", F.col("term").alias("word")), "term_id")
    return top_words(named.select("topic_id", "word", "prob"), num_words)


def top_words(weights: DataFrame, k: int) -> DataFrame:
    """Heaviest ``k`` words of each topic with their rank, ties by word."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("prob"), F.asc("word"))
    return weights.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topic_word_arrays(words: DataFrame) -> DataFrame:
    """One row per topic with its ranked words; as long as the words asked for."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word", "prob")))
    return words.groupBy("topic_id").agg(ranked.alias("_w")).select(
        "topic_id",
        F.col("_w.word").alias("words"),
        F.arrays_zip(F.col("_w.word").alias("word"), F.col("_w.prob").alias("prob")).alias("word_probs"),
    )


def community_tokens(posts: DataFrame) -> DataFrame:
    """Lower-case title and comments of a post as tokens, nothing removed; a row for every part of a post.

    White space parts the bodies, so the tokens of the parts are those of the whole text.
    """
    title = F.when(is_first_part(posts), F.lower(F.coalesce("post_title", F.lit("")))).otherwise("")
    bodies = F.lower(F.array_join(F.coalesce("comments_bodies", F.array().cast("array<string>")), " "))
    return posts.withColumn("tokens", tx.raw_text_tokens(F.concat_ws(" ", title, bodies)))


def community_vectors(posts: DataFrame, vocab: DataFrame, key: str = "post_id", keep: Sequence[str] = ("subreddit",)) -> DataFrame:
    """(key, …, bag), one row per post: words are counted part by part, and only the counts come together."""
    counted = term_vectors(community_tokens(posts), vocab)
    if "part" not in posts.columns:
        return counted.select(key, *keep, "bag")
    words = counted.select(key, F.explode("bag").alias("w")).groupBy(key, "w.term_id").agg(F.sum("w.cnt").alias("cnt"))
    bags = words.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term_id", "cnt"))).alias("bag"))  # a vocabulary at most
    heads = posts.where(is_first_part(posts)).select(key, *keep)
    return heads.join(bags, key, "left").withColumn("bag", F.coalesce("bag", F.array().cast(BAG)))


def community_topic_weights(doc_topics: DataFrame, community: str = "subreddit") -> DataFrame:
    """Sum of topic probabilities of a community's texts."""
    return doc_topics.groupBy(community, "topic_id").agg(F.sum("prob").alias("weight"))


def topic_shares(doc_topics: DataFrame, weight: str = "prob") -> DataFrame:
    """Share of every topic in all probability mass."""
    totals = doc_topics.groupBy("topic_id").agg(F.sum(weight).alias("weight"))
    whole = one_row(doc_topics, total=F.sum(weight))["total"] or 0.0
    return totals.withColumn("share", F.try_divide(F.col("weight"), F.lit(whole)))


def all_word_weights(model: TopicModel, vocab: DataFrame) -> DataFrame:
    """Every (topic, word, phi); topics times vocabulary rows."""
    return topic_words(model, vocab, model.num_terms).drop("rank")


def term_relevance(weights: DataFrame, vocab_counts: DataFrame, lam: float = 0.6) -> DataFrame:
    """Relevance of a word to a topic: lam log phi + (1 - lam) log(phi / p(word)).

    ``vocab_counts`` has (word, n), the corpus count of each word.
    """
    total = one_row(vocab_counts, total=F.sum("n"))["total"]
    joined = weights.join(vocab_counts, "word")
    share = F.col("n") / total
    relevance = lam * F.ln("prob") + (1 - lam) * F.ln(F.col("prob") / share)
    return joined.filter(F.col("prob") > 0).withColumn("relevance", relevance)


# --- graphs -----------------------------------------------------------------


def first_row_communities(posts: DataFrame, n: int, rank: str = "row_rank") -> DataFrame:
    """The first ``n`` communities in row order."""
    first = first_row(posts.select("subreddit", rank), ["subreddit"], [rank])
    return first.orderBy(rank).limit(n).select("subreddit")


def limit_weights(
    weights: DataFrame,
    first: DataFrame | None = None,
    names: Sequence[str] | None = None,
    top_by_weight: int | None = None,
) -> DataFrame:
    """Restrict topic weights to some communities; a limit wins over a list of names."""
    if first is not None:
        return weights.join(first.select("subreddit"), "subreddit", "left_semi")
    if top_by_weight is not None:
        heavy = weights.groupBy("subreddit").agg(F.sum("weight").alias("w"))
        # Rounded, so that sums of shares that should be equal are a tie.
        kept = heavy.orderBy(F.desc(F.round("w", 9)), F.asc("subreddit")).limit(top_by_weight)
        return weights.join(kept.select("subreddit"), "subreddit", "left_semi")
    if names is not None:
        return weights.filter(F.col("subreddit").isin(list(names)))
    return weights


def topic_name(topic_id="topic_id"):
    return F.concat(F.lit("Topic "), (F.col(topic_id) + 1).cast("string"))


def topic_word_edges(words: DataFrame) -> DataFrame:
    return words.select(topic_name().alias("src"), F.col("word").alias("dst")).distinct()


def community_topic_edges(weights: DataFrame, weighted: bool = True) -> DataFrame:
    edges = weights.select(F.col("subreddit").alias("src"), topic_name().alias("dst"), "weight")
    return edges if weighted else edges.select("src", "dst").distinct()


def typed_topic_edges(weights: DataFrame) -> DataFrame:
    """Unweighted community-topic edges with typed ids."""
    return weights.select(
        F.concat(F.lit("topic_"), F.col("topic_id").cast("string")).alias("src"),
        F.concat(F.lit("subreddit_"), F.col("subreddit")).alias("dst"),
    ).distinct()


def topic_graph(
    words: DataFrame, weights: DataFrame, communities: DataFrame, topics: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of topics, their words and communities.

    A topic node's size is 10 plus 20 times its total community weight.
    """
    word_edges = topic_word_edges(words).withColumn("weight", F.lit(None).cast("double"))
    edges = word_edges.unionByName(community_topic_edges(weights))
    totals = node_weights(community_topic_edges(weights).select(F.col("dst").alias("id"), "weight"))
    topic_nodes = (
        topics.select(topic_name().alias("id"))
        .distinct()
        .join(totals, "id", "left")
        .select("id", F.lit("topic").alias("type"), (10 + 20 * F.coalesce("weight", F.lit(0.0))).alias("size"))
    )
    plain = lambda df, c, t: df.select(
        F.col(c).alias("id"), F.lit(t).alias("type"), F.lit(10.0).alias("size")
    ).distinct()
    nodes = topic_nodes.unionByName(plain(words, "word", "word")).unionByName(
        plain(communities, "subreddit", "community")
    )
    return nodes, edges


def node_weights(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum("weight").alias("weight"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Every (node, neighbour) of an undirected graph as rows, so a hub stays spread out."""
    both = F.explode(
        F.array(
            F.struct(F.col("src").alias("id"), F.col("dst").alias("neighbour")),
            F.struct(F.col("dst").alias("id"), F.col("src").alias("neighbour")),
        )
    ).alias("p")
    return edges.select(both).select("p.*").distinct()


def neighbour_lists(edges: DataFrame, per_row: int = 10_000) -> DataFrame:
    """Sorted neighbour list of every node; a hub takes several rows, numbered by ``part``."""
    ranked = rank_rows(neighbours(edges), [F.col("neighbour")], ["id"], "_rank")
    part = F.floor((F.col("_rank") - 1) / per_row).cast("int").alias("part")
    return ranked.groupBy("id", part).agg(F.sort_array(F.collect_list("neighbour")).alias("neighbours"))


# --- saving and loading -----------------------------------------------------


def save_topic_run(path: str, model: TopicModel, texts: DataFrame, vocab: DataFrame, bow: DataFrame, params: dict) -> None:
    """Model, vocabulary, bags, texts and the parameters that made them, under one path."""
    spark = texts.sparkSession
    model.save(spark, f"{path}/model")
    for name, table in {"texts": texts, "vocab": vocab, "bow": bow}.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    row = [(json.dumps(params, sort_keys=True, default=str),)]
    spark.createDataFrame(row, "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_topic_run(spark: SparkSession, model, vocab):
    """(model, vocabulary) from paths, or the live objects as they are."""
    if isinstance(model, str) != isinstance(vocab, str):
        raise ValueError("give two paths or two live objects")
    if isinstance(model, str):
        return TopicModel.load(spark, model), spark.read.parquet(vocab)
    return model, vocab


