"""Filters, limits, look-ups and counts."""

from datetime import timedelta

from pyspark.sql import functions as F

from driver_queries.adapters import MESSAGES, POSTS, TEXTS, messages, posts, table, texts
from driver_queries.registry import query
from threadlens.functions import posts as px
from threadlens.operators import selection as sel

DATES = ["15-06-1996", "15-06-1998", "15-06-2000"]
DAY = "%Y-%m-%d %H:%M:%S"
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
HALF = timedelta(days=912, hours=12)
STAMP = "yyyy-MM-dd HH:mm:ss"


def _windows_sql() -> str:
    rows = ", ".join(
        f"('{w['window_date']}', TIMESTAMP '{w['lo']:{DAY}}', TIMESTAMP '{w['hi']:{DAY}}')"
        for w in sel.reference_windows(DATES)
    )
    return f"windows(window_date, lo, hi) AS (VALUES {rows})"


@query(
    "posts_in_windows",
    f"""WITH {POSTS}, {_windows_sql()}
    SELECT post_id, subreddit, window_date FROM posts JOIN windows ON post_created_utc BETWEEN lo AND hi""",
)
def posts_in_windows(spark, sf):
    return sel.in_reference_windows(posts(spark, sf), DATES).select("post_id", "subreddit", "window_date")


@query(
    "window_datasets",
    f"""WITH {POSTS}, {_windows_sql()}
    SELECT window_date, post_type AS post_language, count(*) AS n
    FROM posts JOIN windows ON post_created_utc BETWEEN lo AND hi GROUP BY 1, 2""",
)
def window_datasets(spark, sf):
    rows = sel.in_reference_windows(posts(spark, sf), DATES)
    return rows.groupBy("window_date", F.col("post_type").alias("post_language")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "window_lang_pick",
    f"""WITH {POSTS}, {_windows_sql()}
    SELECT post_id, subreddit FROM posts JOIN windows ON post_created_utc BETWEEN lo AND hi
    WHERE window_date = '{DATES[1]}' AND post_type = '1-URGENT'""",
)
def window_lang_pick(spark, sf):
    rows = sel.in_reference_windows(posts(spark, sf).withColumnRenamed("post_type", "post_language"), DATES)
    return sel.pick_dataset(rows, DATES[1], "1-URGENT").select("post_id", "subreddit")


@query(
    "posts_valid_range",
    f"""WITH {POSTS} SELECT post_id, strftime(post_created_utc, '{DAY}') AS created FROM posts
    WHERE post_created_utc >= TIMESTAMP '1996-03-01' AND post_created_utc <= TIMESTAMP '1999-11-30'""",
)
def posts_valid_range(spark, sf):
    kept = sel.created_between(posts(spark, sf), "01-03-1996", "30-11-1999")
    return kept.select("post_id", F.date_format("post_created_utc", STAMP).alias("created"))


@query(
    "posts_open_ranges",
    f"""WITH {POSTS}
    SELECT 'from' AS side, count(*) AS n FROM posts WHERE post_created_utc >= TIMESTAMP '1998-07-04'
    UNION ALL SELECT 'to', count(*) FROM posts WHERE post_created_utc <= TIMESTAMP '1998-07-04'""",
)
def posts_open_ranges(spark, sf):
    rows = posts(spark, sf)
    later = sel.number_of_rows(sel.created_between(rows, start="04-07-1998"))
    earlier = sel.number_of_rows(sel.created_between(rows, end="04-07-1998"))
    return later.select(F.lit("from").alias("side"), "n").unionByName(earlier.select(F.lit("to").alias("side"), "n"))


@query(
    "dedupe_first_seen",
    """SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn = 1""",
)
def dedupe_first_seen(spark, sf):
    keyed = table(spark, sf, "events").withColumn("post_id", F.concat_ws("/", F.col("user_id").cast("string"), "event_type"))
    kept = sel.first_seen(keyed, ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query(
    "unseen_posts",
    """SELECT o_orderkey AS post_id FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def unseen_posts(spark, sf):
    seen = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("post_id"))
    return sel.unseen_posts(table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id")), seen)


@query(
    "limit_per_group",
    """SELECT user_id, event_type, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn <= 3""",
)
def limit_per_group(spark, sf):
    kept = sel.limit_results(table(spark, sf, "events"), 3, ["user_id", "event_type"], ["ts", "event_id"])
    return kept.select("user_id", "event_type", "event_id")


@query(
    "limit_large_groups",
    """SELECT event_type, event_id FROM (
      SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events)
    WHERE rn <= 1500""",
)
def limit_large_groups(spark, sf):
    kept = sel.limit_results(table(spark, sf, "events"), 1500, ["event_type"], ["ts", "event_id"])
    return kept.select("event_type", "event_id")


@query(
    "limit_comments",
    f"""WITH {MESSAGES} SELECT post_id, comment_id FROM replies WHERE comment_rank < 2""",
)
def limit_comments(spark, sf):
    from driver_queries.adapters import replies

    return sel.limit_comments(replies(spark, sf), 2).select("post_id", "comment_id")


@query("community_counts", f"WITH {POSTS} SELECT subreddit, count(*) AS n FROM posts GROUP BY 1")
def community_counts(spark, sf):
    return sel.community_counts(sel.count_posts(posts(spark, sf)))


def _details(spark, sf):
    return table(spark, sf, "nation").select(
        F.col("n_name").alias("subreddit"),
        F.to_date(F.timestamp_seconds(F.col("n_nationkey").cast("long") * 86400)).alias("created_utc"),
        F.length("n_name").cast("long").alias("subscribers"),
    )


@query(
    "community_totals",
    f"""WITH {POSTS} SELECT n_name AS subreddit, coalesce(n, 0) AS total_counter
    FROM nation LEFT JOIN (SELECT subreddit, count(*) AS n FROM posts GROUP BY 1) ON n_name = subreddit""",
)
def community_totals(spark, sf):
    return sel.add_post_counts(_details(spark, sf), posts(spark, sf)).select("subreddit", "total_counter")


@query(
    "community_type_counts",
    f"""WITH {POSTS} SELECT n_name AS subreddit, """
    + ", ".join(f"""count(post_id) FILTER (WHERE post_type = '{t}') AS "{t}" """ for t in PRIORITIES)
    + "FROM nation LEFT JOIN posts ON n_name = subreddit GROUP BY 1",
)
def community_type_counts(spark, sf):
    return sel.add_type_counts(_details(spark, sf).select("subreddit"), posts(spark, sf), PRIORITIES)


@query(
    "community_top_n",
    f"""WITH {POSTS}, top AS (
      SELECT subreddit, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 7)
    SELECT subreddit, n, strftime(TIMESTAMP '1970-01-01' + to_days(n_nationkey::INT), '%Y-%m-%d') AS created
    FROM top JOIN nation ON n_name = subreddit""",
)
def community_top_n(spark, sf):
    counts = sel.count_posts(posts(spark, sf))
    kept, details = sel.filter_communities(counts, _details(spark, sf), top_n=7)
    return details.join(kept, "subreddit").select(
        "subreddit", "n", F.date_format("created_utc", "yyyy-MM-dd").alias("created")
    )


NAMED = ["NATION_3", "NATION_11", "NATION_24"]


@query(
    "community_keep",
    f"""WITH {POSTS}, kept AS (SELECT n_name FROM nation WHERE n_name IN ('NATION_3', 'NATION_11', 'NATION_24'))
    SELECT post_id, subreddit FROM posts WHERE subreddit IN (SELECT n_name FROM kept)""",
)
def community_keep(spark, sf):
    named = sel.keep_communities(_details(spark, sf), NAMED)
    return sel.restrict_details(posts(spark, sf), named).select("post_id", "subreddit")


@query(
    "community_drop",
    f"""WITH {POSTS} SELECT post_id, subreddit FROM posts
    WHERE subreddit NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)
      AND subreddit NOT IN (SELECT n_name FROM nation WHERE n_name LIKE 'NATION_2%')""",
)
def community_drop(spark, sf):
    nations = table(spark, sf, "nation").withColumnRenamed("n_name", "subreddit")
    kept = sel.drop_communities(
        posts(spark, sf), nations.filter("n_regionkey = 1"), nations.filter("subreddit LIKE 'NATION_2%'")
    )
    return kept.select("post_id", "subreddit")


@query(
    "community_exclude",
    f"""WITH {POSTS}, counts AS (SELECT subreddit, count(*) AS n, min(post_id) AS discovery_rank FROM posts GROUP BY 1)
    SELECT subreddit, n FROM counts WHERE subreddit NOT IN ('NATION_2', 'nation_5') AND lower(subreddit) <> 'nation_7'
    ORDER BY discovery_rank LIMIT 9""",
)
def community_exclude(spark, sf):
    counts = posts(spark, sf).groupBy("subreddit").agg(
        F.count(F.lit(1)).alias("n"), F.min("post_id").alias("discovery_rank")
    )
    kept = sel.exclude_communities(counts, ["nation_7"], ignore_case=True)
    return sel.communities_to_search(kept, 9, ["NATION_2", "nation_5"]).select("subreddit", "n")


@query(
    "discovered_communities",
    """SELECT DISTINCT source AS subreddit, 0::BIGINT AS n FROM (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5
      AND source NOT IN ('src1', 'src2')""",
)
def discovered_communities(spark, sf):
    results = table(spark, sf, "documents").select(
        "lang", F.col("lang").alias("term"), F.col("doc_id").alias("rank"), F.col("source").alias("subreddit")
    )
    return sel.discover_communities(results, ["SRC1", "src2"], 5)


@query(
    "selected_communities",
    f"WITH {POSTS} SELECT count(DISTINCT subreddit) AS n FROM posts",
)
def selected_communities(spark, sf):
    return sel.number_of_rows(sel.distinct_values(posts(spark, sf), "subreddit"))


@query(
    "distinct_datasets",
    f"WITH {TEXTS} SELECT DISTINCT subreddit, post_language FROM texts",
)
def distinct_datasets(spark, sf):
    return sel.distinct_values(texts(spark, sf), "subreddit", "post_language")


@query(
    "details_by_subscribers",
    "SELECT n_name AS subreddit, length(n_name)::BIGINT AS subscribers FROM nation",
)
def details_by_subscribers(spark, sf):
    return sel.by_subscribers(_details(spark, sf)).select("subreddit", "subscribers")


SUFFIXES = ["", ".jpg", ".gifv", ".mp4", ".JPG", "?v.redd.it"]


@query(
    "classify_url",
    """WITH urls AS (SELECT page_id, url || CASE page_id % 6
        WHEN 1 THEN '.jpg' WHEN 2 THEN '.gifv' WHEN 3 THEN '.mp4' WHEN 4 THEN '.JPG' WHEN 5 THEN '?v.redd.it' ELSE '' END AS url,
        page_id % 11 = 0 AS is_self FROM pages)
    SELECT page_id, CASE WHEN is_self THEN 'text'
        WHEN regexp_matches(url, '\\.(jpg|jpeg|png|gif)$') THEN 'image'
        WHEN suffix(url, '.gifv') THEN 'gifv'
        WHEN contains(url, 'v.redd.it') OR suffix(url, '.mp4') THEN 'video'
        WHEN prefix(url, 'https://www.reddit.com/gallery/') THEN 'gallery'
        ELSE 'link' END AS post_type FROM urls""",
)
def classify_url(spark, sf):
    chosen = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("page_id") % 6 + 1).cast("int"))
    return table(spark, sf, "pages").select(
        "page_id", px.post_type(F.col("page_id") % 11 == 0, F.concat("url", chosen)).alias("post_type")
    )


@query(
    "combine_text",
    """SELECT doc_id, length(coalesce(title, '') || ' ' || text) AS safe_length,
        length(title || ' ' || text) AS strict_length, length(text) AS n
    FROM (SELECT *, CASE WHEN lang <> 'de' THEN source END AS title FROM documents)""",
)
def combine_text(spark, sf):
    title = F.when(F.col("lang") != "de", F.col("source"))
    return table(spark, sf, "documents").select(
        "doc_id",
        px.text_length(px.combine_text(title, "text")).cast("long").alias("safe_length"),
        px.text_length(px.combine_text(title, "text", null_safe=False)).cast("long").alias("strict_length"),
        px.text_length("text").cast("long").alias("n"),
    )


@query(
    "parse_dates",
    """WITH raw AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT AS s, o_orderdate AS d,
        CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%d-%m-%Y') END AS t
      FROM orders)
    SELECT o_orderkey, strftime(d, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(d, '%Y-%m-%d') AS day,
      CASE WHEN o_orderkey % 5 <> 0 THEN strftime(d, '%Y-%m-%d') END AS parsed, 't' || o_orderkey AS parent FROM raw""",
)
def parse_dates(spark, sf):
    day = F.col("o_orderdate")
    seconds = F.unix_timestamp(day)
    text = F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy/MM/dd")).otherwise(
        F.date_format(day, px.DAY_FIRST)
    )
    parent = F.concat(F.lit("t1_t"), F.col("o_orderkey").cast("string"), F.lit("_x"))
    return table(spark, sf, "orders").select(
        "o_orderkey",
        px.epoch_to_iso(seconds).alias("iso"),
        F.date_format(px.epoch_to_date(seconds), "yyyy-MM-dd").alias("day"),
        F.date_format(px.parse_day(text), "yyyy-MM-dd").alias("parsed"),
        px.bare_parent_id(parent).alias("parent"),
    )


TERMS = {"en": ["the of", "tion and", "by the"], "fr": ["que la", "eau", "élle"], "de": ["und die", "ung der"]}


def _terms_sql() -> str:
    rows = ", ".join(f"('{lang}', '{term}')" for lang, listed in TERMS.items() for term in listed)
    return f"terms(lang, term) AS (VALUES {rows})"


@query(
    "term_search",
    f"""WITH {TEXTS}, {_terms_sql()} SELECT text_id, lang, term FROM texts JOIN terms ON contains(lower(text), term)""",
)
def term_search(spark, sf):
    return sel.search_terms(texts(spark, sf), TERMS, ["text"]).select("text_id", "lang", "term")


@query(
    "term_table_search",
    f"""WITH {TEXTS}, terms AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS term FROM benchmark),
    hits AS (SELECT text_id, term FROM texts JOIN terms ON contains(lower(text), term))
    SELECT text_id, count(*) AS hits, md5(string_agg(term, ' ' ORDER BY term)) AS digest FROM hits GROUP BY 1""",
)
def term_table_search(spark, sf):
    """Every word of the benchmark passages, sought in all texts."""
    from threadlens.operators.term_index import search_term_table

    terms = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("term")).distinct()
    hits = search_term_table(texts(spark, sf).select("text_id", "text"), terms, ["text"], "text_id")
    return hits.groupBy("text_id").agg(F.count(F.lit(1)).alias("hits"), F.md5(F.array_join(F.sort_array(F.collect_list("term")), " ")).alias("digest"))


@query(
    "thread_search",
    f"""WITH {MESSAGES}, {_terms_sql()}
    SELECT DISTINCT post_id, lang, term FROM messages JOIN terms ON contains(lower(body), term)""",
)
def thread_search(spark, sf):
    return sel.thread_search(messages(spark, sf), TERMS, "post_id", "body")


@query(
    "term_first_match",
    f"""WITH {TEXTS}, {_terms_sql()}, ranked AS (
      SELECT text_id, lang, term, row_number() OVER (PARTITION BY text_id ORDER BY
        list_position(['en', 'fr', 'de'], lang),
        list_position({[t for listed in TERMS.values() for t in listed]}, term)) AS rn
      FROM texts JOIN terms ON contains(lower(text), term) WHERE post_language = lang)
    SELECT text_id, lang, term FROM ranked WHERE rn = 1""",
)
def term_first_match(spark, sf):
    hits = sel.search_terms(texts(spark, sf), TERMS, ["text"])
    valid = sel.in_language(hits, "post_language", F.col("lang"))
    kept = sel.first_seen(valid.drop("text"), ["lang_rank", "term_rank"], "text_id")
    return kept.select("text_id", "lang", "term")


@query(
    "drop_deleted",
    f"""WITH {POSTS} SELECT post_id FROM posts WHERE post_author IS NOT NULL""",
)
def drop_deleted(spark, sf):
    named = posts(spark, sf).withColumn("post_author", F.col("post_author").cast("string"))
    return sel.drop_deleted(named, ["post_author"]).select("post_id")


@query(
    "first_rows_ranked",
    "SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS row_rank FROM events",
)
def first_rows_ranked(spark, sf):
    from threadlens.operators.ranking import rank_rows

    ranked = rank_rows(table(spark, sf, "events"), [F.desc("value"), F.asc("event_id")], name="row_rank")
    return ranked.select("event_id", "row_rank")
