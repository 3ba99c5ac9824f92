"""Round trips through every source and sink."""

from pyspark.sql import functions as F

from driver_queries.adapters import MESSAGES, POSTS, posts, replies, thread_posts
from driver_queries.registry import query
from threadlens.operators import threads
from threadlens.runtime import fresh_path
from threadlens.schemas import POSTS as POST_SCHEMA
from threadlens.sources import readers, writers


def _nested(spark, sf):
    """Conversations as stored posts, all columns of the post schema."""
    rows = threads.assemble_posts(thread_posts(spark, sf), replies(spark, sf))
    present = {f.name: f.dataType for f in POST_SCHEMA.fields}
    columns = [
        (F.col(n) if n in rows.columns else F.lit(None)).cast(kind).alias(n) for n, kind in present.items()
    ]
    return rows.select(*columns)


STORED = f"""WITH {MESSAGES}, lists AS (
    SELECT post_id, count(*)::INT AS n, md5(string_agg(body, ' | ' ORDER BY comment_rank)) AS bodies,
      sum(comments_upvote_score)::BIGINT AS score FROM replies GROUP BY 1)
  SELECT post_id, md5(m.body) AS text, coalesce(n, 0) AS comments_num, coalesce(bodies, md5('')) AS bodies,
    coalesce(score, 0) AS score FROM messages m LEFT JOIN lists USING (post_id) WHERE turn = 0"""


def _facts(df):
    return df.select(
        "post_id",
        F.md5("post_text").alias("text"),
        "comments_num",
        F.md5(F.array_join("comments_bodies", " | ")).alias("bodies"),
        F.aggregate("comments_upvote_score", F.lit(0).cast("long"), lambda a, x: a + x).alias("score"),
    )


def _round_trip(spark, sf, format, **options):
    path = fresh_path(spark, f"posts-{format}")
    writers.write_posts(_nested(spark, sf), path, format)
    return _facts(readers.read_posts(spark, path, format, **options))


@query("store_parquet", STORED)
def store_parquet(spark, sf):
    return _round_trip(spark, sf, "parquet")


@query("store_json", STORED)
def store_json(spark, sf):
    return _round_trip(spark, sf, "json")


@query("store_json_array", STORED)
def store_json_array(spark, sf):
    """Files that hold one array of records each, as other tools write them."""
    return _facts(readers.read_posts(spark, _array_files(spark, sf), "json", array=True))


@query("store_json_array_split", STORED)
def store_json_array_split(spark, sf):
    """The same files by the reader that many tasks can share."""
    return _facts(readers.read_posts(spark, _array_files(spark, sf), "json", array=True, split=True))


@query("store_csv_split", STORED)
def store_csv_split(spark, sf):
    """One CSV file by the reader that many tasks can share."""
    path = fresh_path(spark, "posts-one-csv")
    writers.write_csv(_nested(spark, sf), path, files=1)
    return _facts(readers.read_posts(spark, path, "csv", split=True))


def _array_files(spark, sf):
    path = fresh_path(spark, "posts-json-array")
    rows = _nested(spark, sf)
    record = F.to_json(F.struct(*rows.columns))
    groups = max(1, rows.count() // 100)
    arrays = rows.groupBy(F.pmod(F.xxhash64("post_id"), F.lit(groups))).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.select("value").repartition(groups).write.option("maxRecordsPerFile", 1).text(path)
    return path


@query("store_csv", STORED)
def store_csv(spark, sf):
    return _round_trip(spark, sf, "csv")


@query("store_by_community", f"WITH {POSTS} SELECT subreddit, count(*) AS n FROM posts GROUP BY 1")
def store_by_community(spark, sf):
    path = fresh_path(spark, "posts-by-community")
    writers.write_posts(posts(spark, sf), path, by_community=True, run_id="run1")
    landed = spark.read.parquet(path)
    return landed.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n"))


@query(
    "store_summary",
    """SELECT s AS statistic, round(v, 4) AS o_totalprice FROM (
      SELECT 'count' AS s, count(o_totalprice)::DOUBLE AS v FROM orders UNION ALL SELECT 'mean', avg(o_totalprice) FROM orders
      UNION ALL SELECT 'std', stddev_samp(o_totalprice) FROM orders UNION ALL SELECT 'min', min(o_totalprice) FROM orders
      UNION ALL SELECT '25%', quantile_cont(o_totalprice, 0.25) FROM orders UNION ALL SELECT '50%', quantile_cont(o_totalprice, 0.5) FROM orders
      UNION ALL SELECT '75%', quantile_cont(o_totalprice, 0.75) FROM orders UNION ALL SELECT 'max', max(o_totalprice) FROM orders)""",
)
def store_summary(spark, sf):
    path = fresh_path(spark, "summary")
    writers.write_summary(spark.read.parquet(f"{sf}/orders.parquet").select("o_totalprice"), path)
    landed = spark.read.schema("statistic string, o_totalprice double").option("header", True).csv(path)
    return landed.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "store_details",
    """SELECT n_name AS subreddit, '2020-01-' || lpad((n_nationkey + 1)::VARCHAR, 2, '0') AS created,
      n_regionkey::BIGINT AS subscribers, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'about ' || n_name END AS description,
      n_nationkey % 3 = 0 AS over18 FROM nation""",
)
def store_details(spark, sf):
    from threadlens.plans.collection import flatten_communities

    raw = spark.read.parquet(f"{sf}/nation.parquet").select(
        F.col("n_name").alias("display_name"),
        (F.unix_timestamp(F.lit("2020-01-01"), "yyyy-MM-dd") + F.col("n_nationkey") * 86400).alias("created_utc"),
        F.col("n_regionkey").cast("long").alias("subscribers"),
        F.when(F.col("n_nationkey") % 2 != 0, F.concat(F.lit("about "), "n_name")).alias("public_description"),
        (F.col("n_nationkey") % 3 == 0).alias("over18"),
    )
    path = fresh_path(spark, "details")
    writers.write_details(flatten_communities(raw), path)
    landed = readers.read_communities(spark, path)
    return landed.select(
        "subreddit", F.date_format("created_utc", "yyyy-MM-dd").alias("created"), "subscribers", "description", "over18"
    )


@query(
    "collected_posts",
    """WITH s AS (SELECT doc_id, source, lang, text, lower(text) AS l FROM documents),
    terms(lang, term, rank) AS (VALUES ('en', 'the of', 0), ('en', 'by the', 1), ('fr', 'que la', 2), ('de', 'und die', 3)),
    hits AS (SELECT doc_id, source, s.lang, text, terms.lang AS wanted, term, terms.rank FROM s JOIN terms ON contains(l, term)
      WHERE source <> 'src3' AND doc_id % 28 + 1 >= 5),
    w AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' ') AS w FROM s),
    g AS (SELECT doc_id, len(list_filter(w, lambda t: t IN ('the', 'and', 'of'))) AS en,
      len(list_filter(w, lambda t: t IN ('le', 'la', 'que'))) AS fr, len(list_filter(w, lambda t: t IN ('und', 'die', 'der'))) AS de FROM w),
    d AS (SELECT doc_id, CASE WHEN greatest(en, fr, de) = 0 THEN NULL WHEN en = greatest(en, fr, de) THEN 'en'
      WHEN fr = greatest(en, fr, de) THEN 'fr' ELSE 'de' END AS detected FROM g),
    kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rn FROM hits JOIN d USING (doc_id) WHERE detected = wanted)
    SELECT 'd' || doc_id AS post_id, source AS subreddit, wanted AS post_language, term AS search_term, 'link' AS post_type,
      coalesce(n, 0)::INT AS comments_num, md5(text || ' ' || text) AS text, coalesce(n, 0)::INT AS nodes
    FROM kept LEFT JOIN (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) c ON conv_id = doc_id WHERE rn = 1""",
)
def collected_posts(spark, sf):
    """The whole collection: search, filters, first-seen, assembly of comments."""
    from driver_queries.adapters import table
    from threadlens.plans.collection import collect_posts

    day = F.unix_timestamp(F.lit("2020-01-01"), "yyyy-MM-dd") + (F.col("doc_id") % 28) * 86400
    submissions = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"),
        F.col("source").alias("subreddit"),
        F.col("text").alias("title"),
        F.col("text").alias("selftext"),
        F.struct(F.col("lang").alias("name")).alias("author"),
        day.cast("double").alias("created_utc"),
        F.lit(1).cast("long").alias("score"),
        F.lit(1.0).alias("upvote_ratio"),
        F.lit("https://example.com/a").alias("url"),
        F.lit(False).alias("is_self"),
    )
    comments = table(spark, sf, "conversations").select(
        F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("post_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("turn").alias("comment_rank"),
        F.concat(F.lit("t1_"), F.col("turn").cast("string")).alias("parent_id"),
        F.struct(F.col("role").alias("name")).alias("author"),
        F.col("text").alias("body"),
        F.lit(0.0).alias("created_utc"),
        F.lit(1).cast("long").alias("score"),
    )
    found = collect_posts(
        submissions,
        comments,
        {"en": ["the of", "by the"], "fr": ["que la"], "de": ["und die"]},
        {"en": ["the", "and", "of"], "fr": ["le", "la", "que"], "de": ["und", "die", "der"]},
        exclude=["src3"],
        start="05-01-2020",
    )
    return found.select(
        "post_id", "subreddit", "post_language", "search_term", "post_type", "comments_num",
        F.md5("post_title_and_text").alias("text"),
        F.size(F.filter(F.map_values(F.coalesce("comments_graph", F.create_map().cast(found.schema["comments_graph"].dataType))), lambda node: node["id"].isNotNull())).alias("nodes"),
    )


@query("topic_run_reloaded", "SELECT doc_id AS text_id, true AS same FROM documents")
def topic_run_reloaded(spark, sf):
    """A saved model, its vocabulary and parameters, loaded and applied again."""
    from driver_queries.topic_models import trained
    from threadlens.operators import corpus, topics

    model, vectors, vocab = trained(spark, sf)
    path = fresh_path(spark, "topic-run")
    texts = vectors.drop("bag")
    topics.save_topic_run(path, model, texts, vocab, corpus.bag_of_words(texts, vocab), {"num_topics": 4})
    again, words = topics.load_topic_run(spark, f"{path}/model", f"{path}/vocab")
    loaded = topics.term_vectors(spark.read.parquet(f"{path}/texts"), words)
    shares = lambda df: df.groupBy("text_id").agg(F.sort_array(F.collect_list(F.struct("topic_id", F.round("prob", 3).alias("prob")))).alias("shares"))
    live, back = shares(topics.document_topics(model, vectors)), shares(topics.document_topics(again, loaded)).withColumnRenamed("shares", "again")
    apart = F.exists(F.zip_with("shares", "again", lambda a, b: F.abs(a["prob"] - b["prob"]) > 0.002), lambda x: x)
    return live.join(back, "text_id").select("text_id", ((F.size("shares") == F.size("again")) & ~apart).alias("same"))


@query(
    "committed_batches",
    f"""WITH {POSTS} SELECT format, batch, subreddit, count(*) AS posts, sum(post_id)::BIGINT AS ids, max(octet_length(encode(post_type)))::INT AS longest FROM (
      SELECT *, 'day-' || (post_id % 3) AS batch FROM posts), (VALUES ('csv'), ('json'), ('parquet')) f(format) GROUP BY 1, 2, 3""",
)
def committed_batches(spark, sf):
    """Posts in three batches and three formats; every batch is written twice, and one try is never committed."""
    from functools import reduce

    from driver_queries.adapters import posts
    from threadlens.sources.batches import read_batches, write_batch

    rows = posts(spark, sf).select("post_id", "subreddit", "post_type", F.create_map(F.lit("type"), "post_type").alias("more"))
    counts = []
    for form in ("parquet", "json", "csv"):
        root = fresh_path(spark, f"batches-{form}")
        for day in (0, 1, 2, 0, 1, 2):
            write_batch(rows.where(F.col("post_id") % 3 == day), root, f"day-{day}", form, ["subreddit"])
        rows.write.format("parquet").save(f"{root}/tries/_of_batch=day-9/_of_try=broken")
        found = read_batches(spark, root).groupBy("batch", "subreddit")
        counts.append(found.agg(F.count(F.lit(1)).alias("posts"), F.sum("post_id").alias("ids"), F.max(F.octet_length(F.col("more")["type"])).alias("longest")).withColumn("format", F.lit(form)))
    return reduce(lambda a, b: a.unionByName(b), counts).select("format", "batch", "subreddit", "posts", "ids", "longest")
