"""Posts to topics, topics to communities and influential authors."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from threadlens.operators import corpus, influence, topics
from threadlens.runtime import snapshot


class TopicRun(NamedTuple):
    model: object
    texts: DataFrame
    vocab: DataFrame
    bow: DataFrame
    words: DataFrame


def model_topics(
    posts: DataFrame,
    stopwords: Sequence[str] = (),
    num_topics: int = topics.NUM_TOPICS,
    passes: int = topics.PASSES,
    num_words: int = 10,
    no_below: int = corpus.NO_BELOW,
    no_above: float = corpus.NO_ABOVE,
    keep_n: int = corpus.KEEP_N,
    comment_words_in: bool = True,
    patterns: Sequence[str] = (),
    normal_forms: DataFrame | None = None,
    text_preprocessing_type: str | None = None,
    chunk_size: float = topics.CHUNK_SIZE,
    alpha: float | Sequence[float] | None = None,
    language: str | None = None,
) -> TopicRun:
    """Posts to a trained model, its texts, vocabulary, bags of words and topic words.

    ``text_preprocessing_type`` "stemming" uses ``normal_forms``, or the rules of ``language``.
    """
    texts, vocab, bow = corpus.prepare_corpus(
        posts,
        stopwords,
        patterns,
        normal_forms,
        text_preprocessing_type,
        comment_words_in=comment_words_in,
        no_below=no_below,
        no_above=no_above,
        keep_n=keep_n,
        language=language,
    )
    vectors = topics.term_vectors(texts, vocab)
    model = topics.train_topics(vectors, num_topics, passes, chunk_size, alpha=alpha, num_terms=vocab.count())
    words = snapshot(topics.topic_words(model, vocab, num_words), "topic-words")
    return TopicRun(model, texts, vocab, bow, words)


def community_weights(run: TopicRun, posts: DataFrame) -> DataFrame:
    vectors = topics.community_vectors(posts, run.vocab)
    return topics.community_topic_weights(topics.document_topics(run.model, vectors, ["post_id", "subreddit"]))


def topic_community_graph(
    run: TopicRun,
    posts: DataFrame,
    first_communities: int | None = None,
    rank: str = "row_rank",
    names: Sequence[str] | None = None,
    top_by_weight: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of topics, words and communities; a row-order limit wins over names."""
    first = topics.first_row_communities(posts, first_communities, rank) if first_communities else None
    weights = snapshot(community_weights(run, posts), "topic-weights")
    kept = topics.limit_weights(weights, first, names, top_by_weight)
    return topics.topic_graph(run.words, kept, posts.select("subreddit"), run.words)


def influential_authors(run: TopicRun, posts: DataFrame, top_percentage: float = 0.1, count_mode: str = "marker") -> DataFrame:
    return influence.analyze_influence(
        run.model, corpus.authored_texts(posts), run.vocab, run.words, top_percentage, count_mode
    )
