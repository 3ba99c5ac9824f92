"""From raw listings to the posts table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import posts as px
from threadlens.operators import selection, threads
from threadlens.operators.languages import LanguageProfiles, detect_languages


def flatten_submissions(raw: DataFrame, language: str | Column, term: str | Column) -> DataFrame:
    """Raw submissions as post rows."""
    as_column = lambda v: F.lit(v) if isinstance(v, str) else v
    return raw.select(
        "subreddit",
        F.col("id").alias("post_id"),
        F.col("title").alias("post_title"),
        px.author_name("author").alias("post_author"),
        F.col("selftext").alias("post_text"),
        px.combine_text("title", "selftext").alias("post_title_and_text"),
        px.epoch_to_timestamp("created_utc").alias("post_created_utc"),
        F.col("score").alias("post_upvote_score"),
        F.col("upvote_ratio").alias("post_upvote_ratio"),
        F.col("url").alias("post_url"),
        as_column(language).alias("post_language"),
        as_column(term).alias("search_term"),
        px.post_type("is_self", "url").alias("post_type"),
    )


def flatten_comments(raw: DataFrame) -> DataFrame:
    """Raw comments as comment rows with a bare parent id."""
    return raw.select(
        "post_id",
        F.col("id").alias("comment_id"),
        "comment_rank",
        px.bare_parent_id("parent_id").alias("parent_id"),
        px.author_name("author").alias("comments_author"),
        "body",
        px.epoch_to_timestamp("created_utc").alias("comments_created_utc"),
        F.col("score").alias("comments_upvote_score"),
    )


def flatten_communities(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("display_name").alias("subreddit"),
        px.epoch_to_date("created_utc").alias("created_utc"),
        "subscribers",
        px.description_or_empty("public_description").alias("description"),
        "over18",
    )


def collect_posts(
    submissions: DataFrame,
    comments: DataFrame,
    terms: Mapping[str, Sequence[str]],
    stopwords_by_language: Mapping[str, Sequence[str]],
    communities: DataFrame | None = None,
    exclude: Sequence[str] = (),
    post_limit: int | None = None,
    comment_limit: int | None = None,
    start=None,
    end=None,
    check_comments_language: bool = False,
    seen: DataFrame | None = None,
    profiles: LanguageProfiles | None = None,
) -> DataFrame:
    """Search, filter, de-duplicate and assemble posts with their comment arrays and comment map.

    The result limit per (community, term) is taken before the filters, as a search
    would; the first search to find a post gives its language and term. Languages are told by learned
    ``profiles``, or without them by stop words.
    """
    if communities is not None:
        submissions = submissions.join(communities.select("subreddit"), "subreddit", "left_semi")
    submissions = selection.exclude_communities(submissions, exclude)
    hits = selection.search_terms(submissions, terms, ["title", "selftext"])
    if post_limit is not None:
        hits = selection.limit_results(hits, post_limit, ["subreddit", "lang", "term"], ["created_utc", "id"])
    hits = hits.withColumn("_at", px.epoch_to_timestamp("created_utc"))
    hits = selection.created_between(hits, start, end, "_at").drop("_at")
    if profiles:
        told = detect_languages(hits.select("id", "title").distinct(), profiles, "id", "title")
        hits = selection.in_language(hits.join(told, "id", "left"), "detected", F.col("lang")).drop("detected")
    elif stopwords_by_language:  # without a table of languages no text can be guessed, and none is dropped
        hits = hits.withColumn("_lang", _guess("title", stopwords_by_language))
        hits = selection.in_language(hits, "_lang", F.col("lang")).drop("_lang")
    hits = selection.first_seen(hits, ["lang_rank", "term_rank"], "id")
    if seen is not None:
        hits = selection.unseen_posts(hits, seen.select(F.col("post_id").alias("id")), "id")
    posts = flatten_submissions(hits, F.col("lang"), F.col("term"))

    rows = flatten_comments(comments)
    if check_comments_language and profiles:
        rows = rows.join(posts.select("post_id", "post_language"), "post_id")
        told = detect_languages(rows, profiles, "comment_id", "body")
        rows = selection.in_language(rows.join(told, "comment_id", "left"), "detected", F.col("post_language")).drop("detected", "post_language")
    elif check_comments_language and stopwords_by_language:
        languages = posts.select("post_id", "post_language")
        rows = rows.join(languages, "post_id").withColumn("_lang", _guess("body", stopwords_by_language))
        rows = selection.in_language(rows, "_lang", F.col("post_language")).drop("_lang", "post_language")
    if comment_limit is not None:
        rows = selection.limit_comments(rows, comment_limit)
    graph = threads.comment_graph(rows)
    return threads.assemble_posts(posts, rows).join(graph, ["post_id", "part"], "left")


def collected_details(posts: DataFrame, details: DataFrame, *inaccessible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a collection hands over: posts, and details with their counts, both without inaccessible communities.

    A post stored in parts counts once.
    """
    if inaccessible:
        posts, details = (selection.drop_communities(df, *inaccessible) for df in (posts, details))
    whole = posts.where(threads.is_first_part(posts))
    return posts, selection.add_type_counts(selection.add_post_counts(details, whole), whole)


def _guess(text: str, stopwords_by_language: Mapping[str, Sequence[str]]) -> Column:
    from threadlens.functions.text import guess_language

    return guess_language(text, stopwords_by_language)
