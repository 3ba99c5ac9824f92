"""Topic models over the documents, and the graphs read off topic tables."""

from pyspark.sql import functions as F

from driver_queries.adapters import TEXTS, rounded, texts
from driver_queries.registry import query
from driver_queries.texts import JOINED, STOP, TOKENS, joined, tokens
from threadlens.functions import text as tx
from threadlens.operators import corpus, topic_map, topics
from threadlens.runtime import snapshot

NUM_TOPICS = 4

# A fixed word table stands for a trained model where SQL has to follow.
FIXED_WORDS = [
    (0, "the", 0.30, 1), (0, "and", 0.20, 2), (0, "tion", 0.10, 3),
    (1, "que", 0.25, 1), (1, "eau", 0.15, 2), (1, "les", 0.05, 3),
    (2, "und", 0.35, 1), (2, "die", 0.12, 2), (2, "ung", 0.08, 3),
    (3, "los", 0.22, 1), (3, "con", 0.11, 2), (3, "cion", 0.07, 3),
]
WORDS_SQL = "words(topic_id, word, prob, rank) AS (VALUES " + ", ".join(
    f"({t}, '{w}', {p}::DOUBLE, {r})" for t, w, p, r in FIXED_WORDS
) + ")"


def fixed_words(spark):
    return spark.createDataFrame(FIXED_WORDS, "topic_id int, word string, prob double, rank int")


# Topic shares of a text: how often the words of each topic occur in it, out of all hits.
SHARES = f"""{TEXTS}, {WORDS_SQL},
  w AS (SELECT text_id, unnest(regexp_split_to_array(lower(text), '[\\s\\x0b]+')) AS word FROM texts),
  hits AS (SELECT text_id, topic_id, count(*) AS n FROM w JOIN words USING (word) GROUP BY 1, 2),
  doc_topics AS (
  SELECT text_id, topic_id, prob FROM (
    SELECT text_id, topic_id, n / sum(n) OVER (PARTITION BY text_id) AS prob FROM hits) WHERE prob >= 0.01)"""


def fixed_doc_topics(spark, sf):
    """(text_id, topic_id, prob) by counting fixed topic words."""
    words = fixed_words(spark).select("word", "topic_id")
    rows = texts(spark, sf).select("text_id", F.explode(tx.plain_tokens("text")).alias("word"))
    hits = rows.join(words, "word").groupBy("text_id").pivot("topic_id", list(range(NUM_TOPICS))).count().na.fill(0)
    total = sum((F.col(str(t)) for t in range(1, NUM_TOPICS)), F.col("0"))
    shares = F.array(*[F.struct(F.lit(t).alias("topic_id"), (F.col(str(t)) / total).alias("prob")) for t in range(NUM_TOPICS)])
    spread = hits.select("text_id", F.explode(shares).alias("s")).select("text_id", "s.topic_id", "s.prob")
    return topics.above_minimum(spread)


@query(
    "above_minimum",
    f"WITH {SHARES} SELECT text_id, topic_id, round(prob + 3e-11, 9) AS prob FROM doc_topics",
)
def above_minimum(spark, sf):
    return fixed_doc_topics(spark, sf).withColumn("prob", rounded("prob"))


def weights_table(spark, sf):
    owned = fixed_doc_topics(spark, sf).join(texts(spark, sf).select("text_id", "subreddit"), "text_id")
    return snapshot(topics.community_topic_weights(owned), "topic-weights")


WEIGHTS = f"""{SHARES}, weights AS (
  SELECT subreddit, topic_id, sum(prob) AS weight FROM doc_topics JOIN texts USING (text_id) GROUP BY 1, 2)"""


@query(
    "community_weights_fixed",
    f"WITH {WEIGHTS} SELECT subreddit, topic_id, round(weight + 3e-11, 9) AS weight FROM weights",
)
def community_weights_fixed(spark, sf):
    return weights_table(spark, sf).withColumn("weight", rounded("weight"))


@query(
    "topic_shares",
    f"""WITH {SHARES} SELECT topic_id, round(sum(prob) + 3e-11, 9) AS weight,
      round(sum(prob) / (SELECT sum(prob) FROM doc_topics) + 3e-11, 9) AS share FROM doc_topics GROUP BY 1""",
)
def topic_shares(spark, sf):
    shares = topics.topic_shares(snapshot(fixed_doc_topics(spark, sf), "doc-topics"))
    return shares.withColumns({"weight": rounded("weight"), "share": rounded("share")})


@query(
    "term_relevance",
    f"""WITH {TOKENS}, {WORDS_SQL}, counts AS (
      SELECT word, count(*) AS n FROM (SELECT unnest(tokens) AS word FROM tokens) GROUP BY 1)
    SELECT topic_id, word, round(0.6 * ln(prob) + 0.4 * ln(prob / (n / (SELECT sum(n) FROM counts))) + 3e-11, 9) AS relevance
    FROM words JOIN counts USING (word)""",
)
def term_relevance(spark, sf):
    grams = tokens(spark, sf).select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    found = topics.term_relevance(fixed_words(spark), snapshot(grams, "word-counts"))
    return found.select("topic_id", "word", rounded("relevance").alias("relevance"))


@query(
    "topic_graph_edges",
    f"""WITH {WEIGHTS} SELECT DISTINCT 'Topic ' || (topic_id + 1) AS src, word AS dst, NULL::DOUBLE AS weight FROM words
    UNION ALL SELECT subreddit, 'Topic ' || (topic_id + 1), round(weight + 3e-11, 9) FROM weights""",
)
def topic_graph_edges(spark, sf):
    return _graph(spark, sf)[1].withColumn("weight", rounded("weight"))


@query(
    "topic_graph_nodes",
    f"""WITH {WEIGHTS} SELECT 'Topic ' || (topic_id + 1) AS id, 'topic' AS type,
      round(10 + 20 * coalesce(sum(weight), 0) + 3e-11, 9) AS size
    FROM (SELECT DISTINCT topic_id FROM words) LEFT JOIN weights USING (topic_id) GROUP BY topic_id
    UNION ALL SELECT DISTINCT word, 'word', 10 FROM words
    UNION ALL SELECT DISTINCT subreddit, 'community', 10 FROM texts""",
)
def topic_graph_nodes(spark, sf):
    return _graph(spark, sf)[0].withColumn("size", rounded("size"))


def _graph(spark, sf):
    words = fixed_words(spark)
    return topics.topic_graph(words, weights_table(spark, sf), texts(spark, sf), words)


@query(
    "topic_neighbours",
    f"""WITH {WEIGHTS}, e AS (SELECT 'Topic ' || (topic_id + 1) AS a, word AS b FROM words
      UNION SELECT subreddit, 'Topic ' || (topic_id + 1) FROM weights),
    b AS (SELECT a AS id, b AS n FROM e UNION SELECT b, a FROM e),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS place FROM b)
    SELECT id, (place // 5)::INT AS part, string_agg(n, ',' ORDER BY n) AS neighbours FROM r GROUP BY 1, 2""",
)
def topic_neighbours(spark, sf):
    lists = topics.neighbour_lists(_graph(spark, sf)[1], per_row=5)
    return lists.withColumn("neighbours", F.array_join("neighbours", ","))


@query(
    "typed_topic_edges",
    f"WITH {WEIGHTS} SELECT DISTINCT 'topic_' || topic_id AS src, 'subreddit_' || subreddit AS dst FROM weights",
)
def typed_topic_edges(spark, sf):
    return topics.typed_topic_edges(weights_table(spark, sf))


@query(
    "first_row_communities",
    f"""WITH {WEIGHTS}, f AS (SELECT subreddit, min(text_id) AS r FROM texts GROUP BY 1 ORDER BY r LIMIT 5)
    SELECT subreddit, topic_id, round(weight + 3e-11, 9) AS weight FROM weights WHERE subreddit IN (SELECT subreddit FROM f)""",
)
def first_row_communities(spark, sf):
    first = topics.first_row_communities(texts(spark, sf).withColumnRenamed("text_id", "row_rank"), 5)
    kept = topics.limit_weights(weights_table(spark, sf), first)
    return kept.withColumn("weight", rounded("weight"))


@query(
    "heaviest_communities",
    f"""WITH {WEIGHTS}, f AS (SELECT subreddit, sum(weight) AS w FROM weights GROUP BY 1 ORDER BY round(w, 9) DESC, subreddit LIMIT 5)
    SELECT subreddit, topic_id, round(weight + 3e-11, 9) AS weight FROM weights WHERE subreddit IN (SELECT subreddit FROM f)""",
)
def heaviest_communities(spark, sf):
    kept = topics.limit_weights(weights_table(spark, sf), top_by_weight=5)
    return kept.withColumn("weight", rounded("weight"))


@query(
    "top_words_per_language",
    f"""WITH {TOKENS}, c AS (SELECT post_language, word, count(*)::DOUBLE AS prob
      FROM (SELECT post_language, unnest(tokens) AS word FROM tokens) GROUP BY 1, 2)
    SELECT post_language AS topic_id, word, prob, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY post_language ORDER BY prob DESC, word) AS rank FROM c) WHERE rank <= 10""",
)
def top_words_per_language(spark, sf):
    rows = tokens(spark, sf).select(F.col("post_language").alias("topic_id"), F.explode("tokens").alias("word"))
    counts = rows.groupBy("topic_id", "word").agg(F.count(F.lit(1)).cast("double").alias("prob"))
    return topics.top_words(counts, 10)


LANGUAGE_WORDS = f"""{TOKENS}, c AS (SELECT post_language AS topic_id, word, count(*)::DOUBLE AS n
      FROM (SELECT post_language, unnest(tokens) AS word FROM tokens) GROUP BY 1, 2),
    shares AS MATERIALIZED (SELECT topic_id, word, n / sum(n) OVER (PARTITION BY topic_id) AS p FROM c),
    terms AS (SELECT a.topic_id AS a, b.topic_id AS b, w.word, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q
      FROM (SELECT DISTINCT topic_id FROM shares) a JOIN (SELECT DISTINCT topic_id FROM shares) b ON a.topic_id < b.topic_id
      CROSS JOIN (SELECT DISTINCT word FROM shares) w
      LEFT JOIN shares x ON x.topic_id = a.topic_id AND x.word = w.word LEFT JOIN shares y ON y.topic_id = b.topic_id AND y.word = w.word),
    divergences AS MATERIALIZED (SELECT a, b, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS divergence
      FROM terms GROUP BY 1, 2)"""


def language_words(spark, sf):
    """The words of each language as a topic."""
    rows = tokens(spark, sf).select(F.col("post_language").alias("topic_id"), F.explode("tokens").alias("word"))
    return snapshot(rows.groupBy("topic_id", "word").agg(F.count(F.lit(1)).cast("double").alias("prob")), "language-words")


@query("topic_distances", f"WITH {LANGUAGE_WORDS} SELECT a, b, round(divergence + 3e-11, 9) AS divergence FROM divergences")
def topic_distances(spark, sf):
    return topic_map.topic_divergences(language_words(spark, sf)).withColumn("divergence", rounded("divergence"))


@query(
    "topic_places",
    f"""WITH {LANGUAGE_WORDS}, d AS (
      SELECT a AS i, b AS j, divergence AS v FROM divergences UNION ALL SELECT b, a, divergence FROM divergences
      UNION ALL SELECT topic_id, topic_id, 0 FROM (SELECT DISTINCT topic_id FROM shares)),
    r AS (SELECT i, avg(v) AS m FROM d GROUP BY 1), weight AS (SELECT topic_id, sum(n) / (SELECT sum(n) FROM c) AS share FROM c GROUP BY 1)
    SELECT topic_id, round(share + 3e-11, 9) AS share, round(m - (SELECT avg(v) FROM d) / 2 + 3e-11, 9) AS from_centre FROM r JOIN weight ON topic_id = i""",
)
def topic_places(spark, sf):
    """Squared distance of every topic from the centre of the map: with all its axes, what centring the divergences gives."""
    words = language_words(spark, sf)
    axes = words.select("topic_id").distinct().count()
    placed = topic_map.topic_map(words, dims=axes, root=True)
    square = sum((F.col(f"x{i}") * F.col(f"x{i}") for i in range(axes)), F.lit(0.0))
    return placed.select("topic_id", rounded("share").alias("share"), rounded(square).alias("from_centre"))


# The tokenizer's rules one after the other; three full stops stand aside while single ones are looked at.
RAW_RULES = [
    (r"\.\.\.", "\x01"),
    (r"""\.([\s\])}>"'”’»,;:?!]*(?:\s|$))""", r" \1"),
    (r"[:,]([^0-9]|$)", r" \1"),
    (r"[:,]([^0-9]|$)", r" \1"),
    (r"'((?:s|m|d|ll|re|ve)\b)", r" \1"),
    (r"""\x01|--|[\[\](){}<>;@#$%&?!\"“”«»‘’`]""", " "),
    (r"n't\b", " n't"),
    *((rf"\b({a})({b})\b", r"\1 \2") for a, b in tx.CONTRACTIONS),
]


def _raw_sql() -> str:
    out = "lower(text)"
    for pattern, new in RAW_RULES:
        quoted = pattern.replace("'", "''"), new.replace("'", "''")
        out = f"regexp_replace({out}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return out


@query(
    "raw_text_tokens",
    f"""WITH {TEXTS}, raw AS (SELECT text_id, list_filter(regexp_split_to_array({_raw_sql()}, '\\s+'), lambda t: t <> '') AS tokens FROM texts)
    SELECT {JOINED} FROM raw""",
)
def raw_text_tokens(spark, sf):
    return joined(texts(spark, sf).withColumn("tokens", tx.raw_text_tokens("text")))


# --- trained models (checked by invariants in the tests) ---------------------


def trained(spark, sf, passes=2):
    """Model, vectors and vocabulary: passes in chunks of a tenth."""
    prepared = snapshot(tokens(spark, sf), "tokens")
    vocab = snapshot(corpus.vocabulary(prepared, 2, 0.5, 5000), "vocabulary")
    bags = topics.term_vectors(prepared.select("text_id", "subreddit", "author", "tokens"), vocab)
    vectors = snapshot(bags, "vectors")  # words are looked up once; training and scoring read the bags only
    return topics.train_topics(vectors, NUM_TOPICS, passes, chunk_size=0.1, num_terms=vocab.count()), vectors, vocab


@query("lda_topics", "SELECT doc_id AS text_id, true AS whole FROM documents")
def lda_topics(spark, sf):
    """The shares of every text: each from 0.01 to 1, and what is missing to 1 fits the ones left out."""
    model, vectors, _ = trained(spark, sf)
    found = topics.document_topics(model, vectors).groupBy("text_id").agg(F.sum("prob").alias("sum"), F.min("prob").alias("least"), F.count("prob").alias("n"))
    gone = 0.01 * (NUM_TOPICS - F.col("n"))
    return found.select("text_id", ((F.col("least") >= 0.01) & (F.col("sum") <= 1 + 1e-6) & (F.col("sum") >= 1 - gone - 1e-6)).alias("whole"))


@query("topic_words", f"SELECT i::INT AS topic_id, 10::BIGINT AS words, true AS ranked, true AS known FROM range(0, {NUM_TOPICS}) t(i)")
def topic_words(spark, sf):
    """Ten different words of the vocabulary per topic, by falling probability."""
    model, _, vocab = trained(spark, sf)
    listed = topics.topic_words(model, vocab).join(vocab.select(F.col("term").alias("word"), F.lit(1).alias("known")), "word", "left")
    row = F.sort_array(F.collect_list(F.struct("rank", "prob"))).getField("prob")
    grouped = listed.groupBy("topic_id").agg(F.count_distinct("word").alias("words"), row.alias("probs"), (F.count("known") == F.count("word")).alias("known"))
    return grouped.select(F.col("topic_id").cast("int").alias("topic_id"), "words", (F.col("probs") == F.reverse(F.array_sort("probs"))).alias("ranked"), "known")


@query("community_topic_weights", f"WITH {TEXTS} SELECT subreddit, count(*) AS texts, true AS whole FROM texts GROUP BY 1")
def community_topic_weights(spark, sf):
    """The weights of a community add up to its number of texts, less the shares left out."""
    model, vectors, _ = trained(spark, sf, passes=topics.PASSES)
    # written once: the weights and the counts both read the shares
    doc_topics = snapshot(topics.document_topics(model, vectors, ["text_id", "subreddit"]), "topic-shares")
    weights = topics.community_topic_weights(doc_topics).groupBy("subreddit").agg(F.sum("weight").alias("weight"))
    counts = doc_topics.groupBy("subreddit").agg(F.count_distinct("text_id").alias("texts"), F.count("prob").alias("shares"))
    gone = 0.01 * (NUM_TOPICS * F.col("texts") - F.col("shares"))
    whole = (F.col("weight") <= F.col("texts") + 1e-6) & (F.col("weight") >= F.col("texts") - gone - 1e-6)
    return weights.join(counts, "subreddit").select("subreddit", "texts", whole.alias("whole"))


@query("word_weights_trained", f"SELECT i::INT AS topic_id, true AS whole FROM range(0, {NUM_TOPICS}) t(i)")
def word_weights_trained(spark, sf):
    """Every word's weight in every topic of a trained model: they add up to 1, one per vocabulary word."""
    model, _, vocab = trained(spark, sf)
    size = vocab.count()
    weights = topics.all_word_weights(model, vocab)
    grouped = weights.groupBy("topic_id").agg(F.sum("prob").alias("sum"), F.count_distinct("word").alias("n"))
    return grouped.select(F.col("topic_id").cast("int").alias("topic_id"), ((F.abs(F.col("sum") - 1) < 1e-6) & (F.col("n") == size)).alias("whole"))
