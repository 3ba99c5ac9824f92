"""Texts to tokens, phrases, vocabulary and bags of words."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.functions.stems import stems
from threadlens.operators.gram_table import gram_table, join_pairs, pack, phrases_of_slices, unpack
from threadlens.operators.ranking import running_total
from threadlens.operators.threads import is_first_part, part_start
from threadlens.runtime import drop_path, one_row, short_shuffles, snapshot, written

# Phrase detection and vocabulary defaults.
PHRASE_MIN_COUNT = 5
PHRASE_THRESHOLD = 10.0
NO_BELOW = 5
NO_ABOVE = 0.1
KEEP_N = 5000


def post_and_comment_texts(
    posts: DataFrame, comment_words_in: bool = True, keep: Sequence[str] = ("subreddit", "post_author")
) -> DataFrame:
    """Every post text and every comment text as its own document, in one pass over the posts.

    ``part`` 0 is the post, 1, 2, ... its comments; ``text_id`` names the document. Posts
    stored in parts give the same documents as posts in one row.
    """
    first, start = is_first_part(posts), part_start(posts)
    none = F.array().cast("array<string>")
    bodies = F.when(first, F.array(F.col("post_title_and_text"))).otherwise(none)
    if comment_words_in:
        bodies = F.concat(bodies, F.coalesce(F.col("comments_bodies"), none))
    place = F.col("_at") + start + F.when(first, 0).otherwise(1)
    names = [c for c in ("part", "part_start") if c in posts.columns]
    rows = posts.select("post_id", *keep, *names, F.posexplode(bodies).alias("_at", "text")).withColumn("_place", place)
    rows = rows.select("post_id", *keep, F.col("_place").alias("part"), "text")
    return rows.withColumn("text_id", F.concat_ws("#", F.col("post_id").cast("string"), F.col("part").cast("string")))


def authored_texts(posts: DataFrame) -> DataFrame:
    """Documents with their writer; comments and comment authors pair up to the shorter list.

    Posts without comment arrays give their own text; posts in parts give it once.
    """
    first, start = is_first_part(posts), part_start(posts)
    writer = posts.schema["post_author"].dataType.simpleString()
    kind = f"array<struct<text:string,author:{writer}>>"
    shorter = F.least(F.size("comments_bodies"), F.size("comments_author"))
    pairs = F.arrays_zip(F.col("comments_bodies").alias("text"), F.col("comments_author").alias("author")).cast(kind)
    comments = F.coalesce(F.slice(pairs, 1, F.greatest(shorter, F.lit(0))), F.array().cast(kind))
    head = F.when(first, F.array(F.struct(F.col("post_title_and_text").alias("text"), F.col("post_author").alias("author"))).cast(kind)).otherwise(F.array().cast(kind))
    names = [c for c in ("part", "part_start") if c in posts.columns]
    rows = posts.select("post_id", "subreddit", *names, F.posexplode(F.concat(head, comments)).alias("_at", "_t"))
    rows = rows.withColumn("_place", F.col("_at") + start + F.when(first, 0).otherwise(1))
    return rows.select(
        F.concat_ws("#", F.col("post_id").cast("string"), F.col("_place").cast("string")).alias("text_id"),
        "subreddit",
        "_t.author",
        "_t.text",
        F.when(F.col("_place") == 0, "post").otherwise("comment").alias("kind"),
    )


def with_tokens(
    df: DataFrame,
    stopwords: Sequence[str] = (),
    patterns: Sequence[str] = (),
    text: str | Column = "text",
    min_length: int = 3,
) -> DataFrame:
    """Add ``tokens``. ``patterns`` are stop words read as regular expressions."""
    tokens = tx.text_tokens(text, stopwords, min_length)
    if patterns:
        tokens = tx.keep_tokens_regex(tokens, patterns, min_length)
    return df.withColumn("tokens", F.coalesce(tokens, F.array().cast("array<string>")))


def configured_stopwords(config: Mapping[str, Sequence[str]], keys: str | Sequence[str] | None) -> list[str] | None:
    """Words of the named configuration keys; an unknown key is reported and skipped."""
    if keys is None:
        return None
    found: list[str] = []
    for key in [keys] if isinstance(keys, str) else keys:
        if key in config:
            found += config[key]
        else:
            warnings.warn(f"{key!r} is not one of the configured keys {sorted(config)}", stacklevel=2)
    return found


def all_stopwords(
    spark: SparkSession,
    language: str,
    config: Mapping[str, Sequence[str]] | None = None,
    keys: str | Sequence[str] | None = None,
    base: Sequence[str] | None = None,
) -> list[str]:
    """Stop words of a language together with configured ones, lower-cased.

    ``base`` replaces Spark's list, and is needed for languages Spark has none for.
    """
    built_in = tx.default_stopwords(spark, language) if base is None else list(base)
    configured = configured_stopwords(config or {}, keys) or []
    return sorted({w.strip().lower() for w in [*built_in, *configured]})


def map_tokens(df: DataFrame, mapping: DataFrame, language: str | None = None, key: str = "text_id") -> DataFrame:
    """Replace tokens by their normal form (a stem or lemma) from a (lang, token, norm) table.

    Tokens without an entry stay. The mapping may be of any size: it is an equi-join on the placed tokens, which come
    together by row and are put in order there, so the work grows with the tokens however long a text is.
    """
    if language is not None:
        mapping = mapping.filter(F.col("lang") == language)
    forms = mapping.groupBy("token").agg(F.min("norm").alias("norm"))
    forms = snapshot(forms.where(F.col("norm") != F.col("token")), "normal-forms")
    # numbered and written once, so that no later run numbers rows anew
    whole = snapshot(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-texts")
    placed = whole.select("_row", F.posexplode("tokens").alias("_at", "token")).join(forms, "token", "left")
    form = F.struct("_at", F.coalesce("norm", "token").alias("token"))
    replaced = placed.groupBy("_row").agg(F.sort_array(F.collect_list(form)).getField("token").alias("_new"))
    empty = F.when(F.size("tokens") == 0, F.col("tokens"))  # no token, or null
    joined = whole.withColumn("tokens", empty).join(replaced, "_row", "left")
    return joined.withColumn("tokens", F.coalesce("_new", "tokens")).select(*df.columns)


def stem_forms(texts: DataFrame, language: str) -> DataFrame:
    """(lang, token, norm): the stem of every distinct token, by the published rules of the language."""
    tokens = texts.select(F.explode("tokens").alias("token")).distinct()
    return stems(tokens, language).select(F.lit(language).alias("lang"), "token", F.col("stem").alias("norm"))


def normalize_tokens(
    df: DataFrame, kind: str | None, mapping: DataFrame | None, language: str | None = None, key: str = "text_id"
) -> DataFrame:
    """Stemming by rules or a caller table, lemmatisation by a caller table; any other kind leaves the tokens as they are."""
    if kind == "stemming" and mapping is None and language is not None:
        df = snapshot(df, "texts")
        mapping = stem_forms(df, language)
    if kind in ("stemming", "lemmatization"):
        if mapping is None:
            raise ValueError(f"{kind} needs a (lang, token, norm) table")
        return map_tokens(df, mapping, language, key)
    if kind is not None:
        warnings.warn(f"{kind!r} is no known token normalisation; tokens stay unchanged", stacklevel=2)
    return df


# --- phrases ----------------------------------------------------------------


def adjacent_pairs(tokens: str | Column) -> Column:
    """Neighbouring tokens as an array of (a, b)."""
    tokens = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.arrays_zip(F.slice(tokens, 1, n).alias("a"), F.slice(tokens, 2, n).alias("b"))


def gram_counts(texts: DataFrame) -> DataFrame:
    """Counts of single tokens (``b`` null) and of neighbouring pairs, in one pass."""
    singles = F.transform("tokens", lambda t: F.struct(t.alias("a"), F.lit(None).cast("string").alias("b")))
    grams = texts.select(F.explode(F.concat(singles, adjacent_pairs("tokens"))).alias("g"))
    return grams.groupBy("g.a", "g.b").agg(F.count(F.lit(1)).alias("n"))


def phrase_scores(
    texts: DataFrame, min_count: int = PHRASE_MIN_COUNT, threshold: float = PHRASE_THRESHOLD
) -> DataFrame:
    """Pairs that score above ``threshold``: (a, b, phrase, n_a, n_b, n_ab, score).

    score = (n_ab - min_count) / (n_a n_b) * V, with V the number of distinct keys. Keys
    are texts: a pair counts under its joined form, so two splits of one form add up.
    """
    slices = snapshot(pack(texts.select("tokens")), "slices")
    return _scores(snapshot(_grams(slices, min_count, threshold), "grams"), min_count, threshold)


def _grams(slices: DataFrame, min_count: int, threshold: float) -> DataFrame:
    """Counts of tokens, of the pairs that can score above ``threshold``, and of keys."""
    return gram_table(slices, min_count if threshold >= 0 else None)


def _scores(grams: DataFrame, min_count: int, threshold: float) -> DataFrame:
    distinct_keys = one_row(grams.filter(F.col("a").isNull()), n=F.sum("n"))["n"] or 0
    singles = grams.filter(F.col("a").isNotNull() & F.col("b").isNull())
    pairs = grams.filter(F.col("b").isNotNull()).withColumnRenamed("n", "n_ab")
    scored = (
        pairs.join(singles.select("a", F.col("n").alias("n_a")), "a")
        .join(singles.select(F.col("a").alias("b"), F.col("n").alias("n_b")), "b")
        .withColumn(
            "score",
            (F.col("n_ab") - min_count).cast("double")
            / (F.col("n_a") * F.col("n_b")).cast("double")
            * distinct_keys,
        )
    )
    return scored.filter(F.col("score") > threshold).select(
        "a", "b", F.concat_ws("_", "a", "b").alias("phrase"), "n_a", "n_b", "n_ab", "score"
    )


def apply_phrases(texts: DataFrame, phrases: DataFrame, key: str = "text_id") -> DataFrame:
    """Join accepted pairs with ``_``, from left to right and without overlap.

    In a run of consecutive matching pairs the greedy rule takes every other one. Only the distinct pairs of a
    slice of texts that are likely phrases meet the phrases, which may be of any size.
    """
    slices = snapshot(pack(texts), "slices")
    pairs = phrases_of_slices(slices, snapshot(phrases.select("a", "b"), "phrases"))
    return unpack(join_pairs(slices, pairs), texts.schema)


def with_phrases(
    texts: DataFrame, min_count: int = PHRASE_MIN_COUNT, threshold: float = PHRASE_THRESHOLD, key: str = "text_id"
) -> DataFrame:
    """Two passes: pairs first, then pairs of what the first pass made.

    Only keys and tokens go through the passes, packed; other columns are joined at the end. A pass writes its counts, its
    phrases, where they are and its texts, each by a query of its own whose shuffle files go with it, and what the next step does not read
    is dropped.
    """
    spark = texts.sparkSession
    whole, others = texts, [c for c in texts.columns if c not in (key, "tokens")]
    texts = texts.select(key, "tokens")
    with short_shuffles(spark):
        slices, last = written(pack(texts), "slices")
        for step in ("bigrams", "trigrams"):
            grams, counted = written(_grams(slices, min_count, threshold), "grams")
            accepted, found = written(_scores(grams, min_count, threshold).select("a", "b"), "phrases")
            drop_path(spark, counted)
            pairs, met = written(phrases_of_slices(slices, accepted), "pairs")
            drop_path(spark, found)
            slices, made = written(join_pairs(slices, pairs), step)
            drop_path(spark, met)
            drop_path(spark, last)
            last = made
    texts = unpack(slices, texts.schema)
    return whole.select(key, *others).join(texts, key).select(*whole.columns) if others else texts


# --- vocabulary and bags of words -------------------------------------------


def document_frequency(texts: DataFrame) -> DataFrame:
    return (
        texts.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("doc_freq"))
    )


def vocabulary(
    texts: DataFrame, no_below: int = NO_BELOW, no_above: float = NO_ABOVE, keep_n: int | None = KEEP_N
) -> DataFrame:
    """Terms in at least ``no_below`` and at most ``int(no_above * N)`` texts, most frequent first.

    ``term_id`` follows document frequency, ties by term.
    """
    documents = texts.count()
    counts = document_frequency(texts).filter(
        (F.col("doc_freq") >= no_below) & (F.col("doc_freq") <= int(no_above * documents))
    )
    order = [F.desc("doc_freq"), F.asc("term")]
    if keep_n is None:
        numbered = running_total(counts, order, name="term_id")
        return numbered.select("term", F.col("term_id").cast("int").alias("term_id"), "doc_freq")
    # At most keep_n rows are numbered here.
    kept = counts.orderBy(*order).limit(keep_n)
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1
    return kept.select("term", number.alias("term_id"), "doc_freq")


def bag_of_words(texts: DataFrame, vocab: DataFrame, key: str = "text_id") -> DataFrame:
    """(text, term_id, cnt); tokens outside the vocabulary are dropped."""
    rows = texts.select(key, F.explode("tokens").alias("term"))
    known = rows.join(vocab.select("term", "term_id"), "term")
    return known.groupBy(key, "term_id").agg(F.count(F.lit(1)).alias("cnt"))


def prepare_corpus(
    posts: DataFrame,
    stopwords: Sequence[str] = (),
    patterns: Sequence[str] = (),
    normal_forms: DataFrame | None = None,
    text_preprocessing_type: str | None = None,
    comment_words_in: bool = True,
    no_below: int = NO_BELOW,
    no_above: float = NO_ABOVE,
    keep_n: int | None = KEEP_N,
    language: str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Posts with comment arrays to (texts, vocabulary, bags of words)."""
    texts = with_tokens(post_and_comment_texts(posts, comment_words_in), stopwords, patterns)
    texts = normalize_tokens(texts, text_preprocessing_type, normal_forms, language)
    texts = with_phrases(texts)
    vocab = snapshot(vocabulary(texts, no_below, no_above, keep_n), "vocabulary")
    return texts, vocab, bag_of_words(texts, vocab)


# --- language and sentiment -------------------------------------------------


def with_language(
    df: DataFrame, stopwords_by_language: Mapping[str, Sequence[str]], text: str = "text", name: str = "detected"
) -> DataFrame:
    return df.withColumn(name, tx.guess_language(text, stopwords_by_language))


def sentiment_labels(df: DataFrame, lexicon: DataFrame, key: str = "text_id", text: str = "text") -> DataFrame:
    """Sentiment of each text from a (word, valence) lexicon; no known word is unknown."""
    rows = df.select(key, F.explode(tx.plain_tokens(F.regexp_replace(text, r"[^\p{L}\p{N}']+", " "))).alias("word"))
    # written once, so that the planner knows its size and does not move the tokens to it
    lexicon = snapshot(lexicon, "lexicon")
    sums = rows.join(lexicon, "word").groupBy(key).agg(F.sum("valence").alias("_total"))
    joined = df.join(sums, key, "left").withColumn("compound", tx.compound_valence("_total"))
    return joined.withColumn("sentiment", tx.sentiment_class("compound")).drop("_total")
