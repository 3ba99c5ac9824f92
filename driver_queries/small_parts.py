"""Small operators, each over a whole table: dates, names, configuration, files, stop words."""

import json

from pyspark.sql import functions as F

from driver_queries.adapters import TEXTS, posts, table, texts
from driver_queries.author_leaders import SCORES, score_table
from driver_queries.author_metrics import METRICS_SQL
from driver_queries.registry import query
from threadlens.functions import posts as px
from threadlens.functions import text as tx
from threadlens.operators import corpus, leaders, selection
from threadlens.runtime import fresh_path
from threadlens.sources import config, writers

TERMS = {"en": ["the", "and", "the"], "de": ["und"], "fr": ["les", "que"]}


def _stored_config(spark):
    """A configuration file in the shared folder, read back as any path that Spark knows."""
    path = fresh_path(spark, "terms")
    spark.range(1).select(F.lit(json.dumps(TERMS)).alias("value")).write.text(path)
    return json.loads(spark.read.text(path).first().value)


@query(
    "configured_terms",
    """WITH terms(lang, term, lang_rank, term_rank) AS (VALUES ('en', 'the', 0, 0), ('en', 'and', 0, 1), ('de', 'und', 1, 0), ('fr', 'les', 2, 0), ('fr', 'que', 2, 1))
    SELECT t.lang, t.term, t.lang_rank::INT AS lang_rank, t.term_rank::INT AS term_rank, count(*) AS texts
    FROM terms t JOIN documents d ON d.lang = t.lang AND contains(lower(d.text), t.term) GROUP BY ALL""",
)
def configured_terms(spark, sf):
    """Configured terms, a repeated one at its first place, with the texts of their language that have them."""
    terms = config.terms_table(spark, _stored_config(spark))
    found = table(spark, sf, "documents").select("lang", "text").join(terms, "lang").where(F.contains(F.lower("text"), F.col("term")))
    return found.groupBy("lang", "term", "lang_rank", "term_rank").agg(F.count(F.lit(1)).alias("texts"))


@query(
    "dates_and_back",
    """SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day,
      strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS by_day FROM orders""",
)
def dates_and_back(spark, sf):
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), seconds.alias("s"))
    rows = rows.select("id", px.epoch_to_iso("s").alias("iso"), px.epoch_to_date("s").alias("d"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.select(
        "id", "iso", F.date_format("d", "yyyy-MM-dd").alias("day"), shown(px.parse_iso("iso")).alias("parsed"), shown(px.parse_day(F.date_format("d", "dd-MM-yyyy"), strict=True)).alias("by_day")
    )


@query(
    "language_names",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS name FROM documents""",
)
def language_names(spark, sf):
    return table(spark, sf, "documents").select("doc_id", px.language_name_column("lang").alias("name"))


@query(
    "community_descriptions",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS description, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS author FROM customer""",
)
def community_descriptions(spark, sf):
    name = F.col("c_name")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 != 0, name).alias("about"), F.when(F.col("c_custkey") % 5 != 0, F.struct(name.alias("name"))).alias("writer")
    )
    return rows.select("id", px.description_or_empty("about").alias("description"), px.author_name("writer").alias("author"))


@query(
    "stored_outliers",
    f"""WITH {SCORES}, z AS (SELECT *, (popularity_pc - avg(popularity_pc) OVER ()) / stddev_pop(popularity_pc) OVER () AS z1,
      (engagement_pc - avg(engagement_pc) OVER ()) / stddev_pop(engagement_pc) OVER () AS z2,
      (initiative_pc - avg(initiative_pc) OVER ()) / stddev_pop(initiative_pc) OVER () AS z3 FROM scores)
    SELECT post_author, round(popularity_pc, 5) AS popularity_pc FROM z WHERE greatest(abs(z1), abs(z2), abs(z3)) > 1.959963984540054""",
)
def stored_outliers(spark, sf):
    """Outliers written as CSV and read back."""
    path = fresh_path(spark, "outliers")
    writers.write_outliers(leaders.zscore_outliers(score_table(spark, sf), 0.05), path)
    landed = spark.read.schema("post_author long, popularity_pc double, engagement_pc double, initiative_pc double").option("header", True).csv(path)
    return landed.select("post_author", F.round("popularity_pc", 5).alias("popularity_pc"))


@query(
    "stored_graph",
    """SELECT 'node' AS kind, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 'edge', n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def stored_graph(spark, sf):
    pairs = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))
    path = fresh_path(spark, "graph")
    writers.write_graph(pairs, pairs, path)
    read = lambda kind: spark.read.parquet(f"{path}/{kind}s").select(F.lit(kind).alias("kind"), "a", "b")
    return read("node").unionByName(read("edge"))


@query("cluster_parts", f"WITH {METRICS_SQL} SELECT count(*) AS authors, true AS apart FROM user_metrics")
def cluster_parts(spark, sf):
    """The members of the six clusters, picked one by one: all authors, none twice."""
    clustered = leaders.cluster_authors(score_table(spark, sf))
    picked = [leaders.cluster_members(clustered, i).select("post_author") for i in range(6)]
    rows = picked[0]
    for more in picked[1:]:
        rows = rows.unionByName(more)
    counts = rows.groupBy(F.coalesce("post_author", F.lit(-1)).alias("who")).count()
    return counts.agg(F.sum("count").alias("authors"), (F.max("count") == 1).alias("apart"))


@query("first_rows", "SELECT 5::BIGINT AS n, true AS known")
def first_rows(spark, sf):
    """Any five rows, all of the table."""
    rows = selection.preview(posts(spark, sf).select("post_id"))
    return rows.join(table(spark, sf, "orders"), F.col("post_id") == F.col("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) == 5).alias("known"))


@query(
    "all_stop_words",
    f"""WITH {TEXTS}, w AS (SELECT text_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM texts)
    SELECT text_id, count(*) FILTER (WHERE word IN ('the', 'and', 'of', 'que', 'tion')) AS hits FROM w GROUP BY 1""",
)
def all_stop_words(spark, sf):
    """A base list and two configured ones; an unknown key is skipped."""
    words = corpus.all_stopwords(spark, "en", {"more": ["Que ", "tion"], "unused": ["re"]}, ["more"], base=["The", "and", "of"])
    hits = tx.stop_hits(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), words)
    return texts(spark, sf).select("text_id", hits.cast("long").alias("hits"))


# The words of Spark's English list that are one run of letters.
ENGLISH_STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
  its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
  having do does did doing a an the and but if or because as until while of at by for with about against between into through during
  before after above below to from up down in out on off over under again further then once here there when where why how all any both
  each few more most other some such no nor not only own same so than too very s t can will just don should now could would cannot
  ought""".split()


@query(
    "default_stop_words",
    f"""WITH {TEXTS}, w AS (SELECT text_id, unnest(string_split(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' ')) AS word FROM texts)
    SELECT text_id, count(*) FILTER (WHERE list_contains({ENGLISH_STOP_WORDS}, word)) AS hits FROM w GROUP BY 1""",
)
def default_stop_words(spark, sf):
    """Words of the whole English default list in every text."""
    hits = tx.stop_hits(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), tx.default_stopwords(spark, "en"))
    return texts(spark, sf).select("text_id", hits.cast("long").alias("hits"))


@query(
    "details_of_a_collection",
    """WITH p AS (SELECT n_name AS subreddit, o_orderpriority AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    SELECT n_name AS subreddit, count(t) AS total_counter, count(*) FILTER (WHERE t = '1-URGENT') AS urgent
    FROM nation LEFT JOIN p ON p.subreddit = n_name WHERE n_name <> 'NATION_3' GROUP BY 1""",
)
def details_of_a_collection(spark, sf):
    """Posts and details with counts, without an inaccessible community."""
    from threadlens.plans.collection import collected_details

    details = table(spark, sf, "nation").select(F.col("n_name").alias("subreddit"))
    gone = details.where("subreddit = 'NATION_3'")
    kept, counted = collected_details(posts(spark, sf).withColumn("post_type", F.col("post_type")), details, gone)
    urgent = kept.groupBy("subreddit").agg(F.count_if(F.col("post_type") == "1-URGENT").alias("urgent"))
    return counted.select("subreddit", "total_counter").join(urgent, "subreddit", "left").na.fill(0, ["urgent"])
