"""Filters, look-ups, counts, limits and set operations over posts and communities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.posts import literal_structs
from threadlens.functions.text import bind, contains_text
from threadlens.operators.ranking import first_per_group, first_row, rank_rows
from threadlens.operators.threads import is_first_part, part_start

# The default reference dates and the half width of their windows.
DEFAULT_REFERENCE_DATES = ["25-05-2014", "26-05-2019", "09-06-2024"]
HALF_WINDOW = timedelta(days=365 * 2.5)

POST_TYPES = ["text", "image", "gifv", "video", "gallery", "link"]


def _moment(df: DataFrame, created: str, day: str | datetime) -> Column:
    """A day as a constant of the column's own timestamp type, so that the scan can filter on it."""
    if isinstance(day, str):
        day = datetime.strptime(day, "%d-%m-%Y")
    return F.lit(day.isoformat(sep=" ")).cast(df.schema[created].dataType)


# --- filters ---------------------------------------------------------------


def created_between(df: DataFrame, start=None, end=None, created: str = "post_created_utc") -> DataFrame:
    """Rows created in [start, end]; either side may be open. Days are ``DD-MM-YYYY``."""
    if start is not None:
        df = df.filter(F.col(created) >= _moment(df, created, start))
    if end is not None:
        df = df.filter(F.col(created) <= _moment(df, created, end))
    return df


def in_language(df: DataFrame, detected: str | Column, requested: str | Column) -> DataFrame:
    """Rows whose detected language is the requested one; undetected rows go."""
    detected = F.col(detected) if isinstance(detected, str) else detected
    requested = F.lit(requested) if isinstance(requested, str) else requested
    # Coalesced, so that no separate null test computes the detection once more.
    return df.filter(F.coalesce(detected == requested, F.lit(False)))


def exclude_communities(
    df: DataFrame, names: Sequence[str], ignore_case: bool = False, community: str = "subreddit"
) -> DataFrame:
    """Drop listed communities, by exact name or with the name lower-cased first."""
    if not names:
        return df
    key = F.lower(community) if ignore_case else F.col(community)
    return df.filter(F.coalesce(~key.isin(list(names)), F.lit(True)))


def keep_communities(df: DataFrame, names: Sequence[str], community: str = "subreddit") -> DataFrame:
    return df.filter(F.col(community).isin(list(names)))


def drop_deleted(df: DataFrame, authors: Sequence[str] = ("post_author", "comments_author")) -> DataFrame:
    """Drop rows with a deleted author in any of the given columns."""
    for author in authors:
        df = df.filter(F.col(author).isNotNull() & (F.col(author) != "[deleted]"))
    return df


def unseen_posts(df: DataFrame, seen: DataFrame, key: str = "post_id") -> DataFrame:
    """Rows whose id is not in the table of seen ids."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def first_seen(df: DataFrame, order: Sequence[str], key: str = "post_id") -> DataFrame:
    """One row per id: the first in search order."""
    return first_row(df, [key], order)


def reference_windows(dates: Sequence[str] = DEFAULT_REFERENCE_DATES, half: timedelta = HALF_WINDOW) -> list[dict]:
    windows = []
    for day in dates:
        try:
            middle = datetime.strptime(day, "%d-%m-%Y")
        except ValueError:
            raise ValueError(f"{day!r} is not a DD-MM-YYYY date") from None
        windows.append({"window_date": day, "lo": middle - half, "hi": middle + half})
    return windows


def in_reference_windows(
    df: DataFrame, dates: Sequence[str] = DEFAULT_REFERENCE_DATES, created: str = "post_created_utc"
) -> DataFrame:
    """One row per post and window that contains it, bounds included.

    The windows are an argument list, so they travel inside the expression: the range
    join becomes a filter of a literal array. The outer bounds reach the scan.
    """
    windows = [
        {**w, "lo": _moment(df, created, w["lo"]), "hi": _moment(df, created, w["hi"])}
        for w in reference_windows(dates)
    ]
    lows, highs = [w["lo"] for w in windows], [w["hi"] for w in windows]
    lows, highs = lows + lows[:1], highs + highs[:1]
    hits = F.filter(
        literal_structs(windows),
        lambda w: F.col(created).between(w.getField("lo"), w.getField("hi")),
    )
    return (
        df.filter(F.col(created).between(F.least(*lows), F.greatest(*highs)))
        .select("*", F.explode(hits).alias("_window"))
        .select(*df.columns, F.col("_window.window_date"))
    )


def pick_dataset(df: DataFrame, window_date: str = "25-05-2014", language: str = "en") -> DataFrame:
    return df.filter((F.col("window_date") == window_date) & (F.col("post_language") == language))


# --- term search -----------------------------------------------------------


def term_rows(terms: Mapping[str, Sequence[str]]) -> list[dict]:
    """A language -> terms configuration as ranked rows; a repeated term keeps its first place."""
    rows = []
    for i, (lang, listed) in enumerate(terms.items()):
        for j, term in enumerate(dict.fromkeys(listed)):
            rows.append({"lang": lang, "term": term, "lang_rank": i, "term_rank": j})
    return rows


def search_terms(
    df: DataFrame, terms: Mapping[str, Sequence[str]], texts: Sequence[str], arrays: Sequence[str] = ()
) -> DataFrame:
    """One row per row and term found in any text column or any element of an array column.

    The terms are configuration and travel as a literal array: one pass over the text,
    no join. Matching ignores case.
    """
    rows = [{**row, "needle": row["term"].lower()} for row in term_rows(terms)]
    fields = [F.lower(F.col(c)).alias(f"t{i}") for i, c in enumerate(texts)]
    fields += [F.transform(F.col(c), F.lower).alias(f"a{i}") for i, c in enumerate(arrays)]

    def found(low: Column):
        def any_text(term: Column) -> Column:
            needle, hit = term.getField("needle"), F.lit(False)
            for i in range(len(texts)):
                hit = hit | F.coalesce(F.contains(low.getField(f"t{i}"), needle), F.lit(False))
            for i in range(len(arrays)):
                hit = hit | F.coalesce(F.exists(low.getField(f"a{i}"), lambda body: F.contains(body, needle)), F.lit(False))
            return hit

        return F.filter(literal_structs(rows), any_text)

    # the texts are lower-cased once per row, not once per term
    hits = F.explode(bind(F.struct(*fields), found)).alias("_term")
    return df.select("*", hits).select(*df.columns, "_term.lang", "_term.term", "_term.lang_rank", "_term.term_rank")


def thread_search(
    df: DataFrame, terms: Mapping[str, Sequence[str]], thread: str, text: str
) -> DataFrame:
    """Threads in which any message contains a term: distinct (thread, lang, term)."""
    hits = search_terms(df.select(thread, text), terms, [text])
    return hits.select(thread, "lang", "term").distinct()


def limit_results(df: DataFrame, n: int, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """At most ``n`` results per search (community and term), in result order."""
    return first_per_group(df, n, group, [F.col(c) for c in order])


def limit_comments(df: DataFrame, n: int, post: str = "post_id", order: Sequence[str] = ("comment_rank",)) -> DataFrame:
    return first_per_group(df, n, [post], [F.col(c) for c in order])


def limit_comment_arrays(df: DataFrame, n: int, arrays: Sequence[str]) -> DataFrame:
    """At most ``n`` comments per post; the later parts of a post keep what the earlier ones leave."""
    left = F.greatest(F.lit(n) - part_start(df), F.lit(0))
    cut = df.withColumns({a: F.slice(F.col(a), F.lit(1), left) for a in arrays})
    return cut.where(is_first_part(df) | (left > 0))


# --- communities -----------------------------------------------------------


def count_posts(df: DataFrame, community: str = "subreddit", name: str = "n") -> DataFrame:
    return df.groupBy(community).agg(F.count(F.lit(1)).alias(name))


def count_post_types(
    df: DataFrame, types: Sequence[str] = POST_TYPES, community: str = "subreddit", kind: str = "post_type"
) -> DataFrame:
    """Posts per community and type, one column per type; the types are named, so no extra job."""
    return df.groupBy(community).agg(*[F.count_if(F.col(kind) == t).alias(t) for t in types])


def add_post_counts(details: DataFrame, posts: DataFrame, name: str = "total_counter") -> DataFrame:
    """Post count per community on the details; none means 0."""
    counts = count_posts(posts, name=name)
    return details.join(counts, "subreddit", "left").na.fill(0, [name])


def add_type_counts(details: DataFrame, posts: DataFrame, types: Sequence[str] = POST_TYPES) -> DataFrame:
    return details.join(count_post_types(posts, types), "subreddit", "left").na.fill(0, list(types))


def discover_communities(
    results: DataFrame, excluded: Sequence[str] = (), limit: int | None = None
) -> DataFrame:
    """Distinct community names over all searches, each with a count of 0.

    ``results`` has one row per search hit: lang, term, rank, subreddit.
    """
    if limit is not None:
        results = first_per_group(results, limit, ["lang", "term"], [F.col("rank")])
    kept = exclude_communities(results, [n.lower() for n in excluded], ignore_case=True)
    return kept.select("subreddit").distinct().withColumn("n", F.lit(0).cast("long"))


def community_counts(counts: DataFrame) -> DataFrame:
    return counts.select("subreddit", "n")


def top_communities(counts: DataFrame, n: int) -> DataFrame:
    """The ``n`` communities with most posts, ties by name."""
    return counts.orderBy(F.desc("n"), F.asc("subreddit")).limit(n)


def first_communities(counts: DataFrame, n: int, rank: str = "discovery_rank") -> DataFrame:
    return counts.orderBy(F.asc(rank)).limit(n)


def filter_communities(
    counts: DataFrame, details: DataFrame, top_n: int | None = None, names: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Keep the top ``n`` or the named communities in both tables; exactly one choice."""
    if bool(top_n) == bool(names):
        raise ValueError("give either top_n or names")
    kept = top_communities(counts, top_n) if top_n else keep_communities(counts, names)
    return kept, restrict_details(details, kept)


def restrict_details(details: DataFrame, kept: DataFrame) -> DataFrame:
    return details.join(kept.select("subreddit"), "subreddit", "left_semi")


def drop_communities(df: DataFrame, *inaccessible: DataFrame) -> DataFrame:
    """Drop the communities named in any of the given lists."""
    listed = inaccessible[0].select("subreddit")
    for other in inaccessible[1:]:
        listed = listed.union(other.select("subreddit"))
    return df.join(listed.distinct(), "subreddit", "left_anti")


def communities_to_search(counts: DataFrame, limit: int | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    kept = exclude_communities(counts, exclude)
    return first_communities(kept, limit) if limit else kept


def by_subscribers(details: DataFrame) -> DataFrame:
    return details.orderBy(F.desc("subscribers"), F.asc("subreddit"))


def number_of_rows(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def with_row_rank(df: DataFrame, order: Sequence[str], name: str = "row_rank") -> DataFrame:
    return rank_rows(df, [F.col(c) for c in order], name=name)


def matches_term(text: str | Column, term: str) -> Column:
    return contains_text(text, term)
