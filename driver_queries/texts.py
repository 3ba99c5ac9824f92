"""Cleaning, tokens, phrases, vocabulary, language and sentiment."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driver_queries.adapters import TEXTS, rounded, texts
from driver_queries.registry import query
from threadlens.functions import text as tx
from threadlens.functions.stems import STEMMERS, Dialect, stems
from threadlens.operators import corpus
from threadlens.runtime import snapshot

STOP = ["the", "and", "with", "for", "que", "les", "des", "und", "die", "der"]
CLEANED = f"regexp_replace(text, '{tx.NOISE}', ' ', 'g')".replace("{{", "{").replace("}}", "}")
CONTRACTED = "|".join(a + b for a, b in tx.CONTRACTIONS)


def _spaced_sql() -> str:
    out = CLEANED
    for a, b in tx.CONTRACTIONS:
        out = f"regexp_replace({out}, '(?i)\\b({a})({b})\\b', '\\1 \\2', 'g')"
    return out


TOKENS = f"""{TEXTS}, tokens AS (
  SELECT text_id, subreddit, post_language,
    list_filter(string_split(lower({_spaced_sql()}), ' '), lambda t: length(t) > 2 AND NOT list_contains({STOP}, t)) AS tokens
  FROM texts)"""


def tokens(spark, sf):
    """Dealt by id first: a file of one row group is one task, and cleaning is work on every character."""
    return corpus.with_tokens(texts(spark, sf).repartition("text_id"), STOP)


def token_table(spark, sf):
    """Tokens written once, for queries that read them several times."""
    return snapshot(tokens(spark, sf).select("text_id", "tokens"), "tokens")


def joined(df):
    """Order-keeping fingerprint of a token list."""
    return df.select("text_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


JOINED = "text_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest"


@query("clean_text", f"WITH {TEXTS} SELECT text_id, md5({CLEANED}) AS digest FROM texts")
def clean_text(spark, sf):
    return texts(spark, sf).select("text_id", F.md5(tx.clean_text("text")).alias("digest"))


@query("clean_tokens", f"WITH {TOKENS} SELECT {JOINED} FROM tokens")
def clean_tokens(spark, sf):
    return joined(tokens(spark, sf))


@query(
    "regex_stopwords",
    f"""WITH {TOKENS}, kept AS (
      SELECT text_id, list_filter(tokens, lambda t: NOT regexp_full_match(t, 'eau[a-z]*|[a-z]*tion')) AS tokens FROM tokens)
    SELECT {JOINED} FROM kept""",
)
def regex_stopwords(spark, sf):
    return joined(corpus.with_tokens(texts(spark, sf), STOP, ["\\\\beau[a-z]*\\\\b", "\\\\b[a-z]*tion\\\\b"]))


@query(
    "plain_tokens",
    f"""WITH {TEXTS}, plain AS (
      SELECT text_id, list_filter(regexp_split_to_array(lower(text), '[\\s\\x0b]+'), lambda t: t <> '') AS tokens FROM texts)
    SELECT {JOINED} FROM plain""",
)
def plain_tokens(spark, sf):
    return joined(texts(spark, sf).withColumn("tokens", tx.plain_tokens("text")))


@query(
    "doc_freq",
    f"""WITH {TOKENS} SELECT term, count(DISTINCT text_id) AS doc_freq
    FROM (SELECT text_id, unnest(tokens) AS term FROM tokens) GROUP BY 1""",
)
def doc_freq(spark, sf):
    return corpus.document_frequency(tokens(spark, sf))


VOCAB = f"""{TOKENS}, words AS (SELECT text_id, unnest(tokens) AS term FROM tokens),
  vocab AS (
  SELECT term, row_number() OVER (ORDER BY doc_freq DESC, term) - 1 AS term_id, doc_freq
  FROM (SELECT term, count(DISTINCT text_id) AS doc_freq FROM words GROUP BY 1)
  WHERE doc_freq >= 5 AND doc_freq <= floor(0.1 * (SELECT count(*) FROM texts))
  ORDER BY doc_freq DESC, term LIMIT 500)"""


@query("vocab_filter", f"WITH {VOCAB} SELECT term, term_id, doc_freq FROM vocab")
def vocab_filter(spark, sf):
    return corpus.vocabulary(tokens(spark, sf), 5, 0.1, 500)


@query("vocab_unbounded", f"WITH {VOCAB.replace('LIMIT 500', '')} SELECT term, term_id, doc_freq FROM vocab")
def vocab_unbounded(spark, sf):
    return corpus.vocabulary(tokens(spark, sf), 5, 0.1, None)


@query(
    "bag_of_words",
    f"WITH {VOCAB} SELECT text_id, term_id, count(*) AS cnt FROM words JOIN vocab USING (term) GROUP BY 1, 2",
)
def bag_of_words(spark, sf):
    prepared = token_table(spark, sf)
    return corpus.bag_of_words(prepared, snapshot(corpus.vocabulary(prepared, 5, 0.1, 500), "vocabulary"))


def _grams_sql(name: str, source: str) -> str:
    """CTEs: rows of tokens, gram keys and scored pairs over a token table."""
    return f"""{name}_rows AS (
    SELECT text_id, pos, t AS a, lead(t) OVER (PARTITION BY text_id ORDER BY pos) AS b
    FROM (SELECT text_id, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS pos FROM {source})),
  {name}_keys AS (
    SELECT key, count(*) AS n FROM (
      SELECT a AS key FROM {name}_rows UNION ALL SELECT a || '_' || b FROM {name}_rows WHERE b IS NOT NULL) GROUP BY 1),
  {name}_scores AS (
    SELECT p.a, p.b, p.a || '_' || p.b AS phrase, x.n AS n_a, y.n AS n_b, k.n AS n_ab,
      (k.n - 5)::DOUBLE / (x.n * y.n)::DOUBLE * (SELECT count(*) FROM {name}_keys) AS score
    FROM (SELECT DISTINCT a, b FROM {name}_rows WHERE b IS NOT NULL) p
    JOIN {name}_keys k ON k.key = p.a || '_' || p.b
    JOIN {name}_keys x ON x.key = p.a JOIN {name}_keys y ON y.key = p.b),
  {name}_phrases AS (SELECT * FROM {name}_scores WHERE score > 10)"""


def _applied_sql(name: str) -> str:
    """CTEs that join the accepted pairs left to right: every other match of a run."""
    return f"""{name}_hits AS (
    SELECT text_id, pos, pos - row_number() OVER (PARTITION BY text_id ORDER BY pos) AS run
    FROM {name}_rows SEMI JOIN {name}_phrases USING (a, b)),
  {name}_taken AS (
    SELECT text_id, pos FROM (
      SELECT *, row_number() OVER (PARTITION BY text_id, run ORDER BY pos) AS turn FROM {name}_hits) WHERE turn % 2 = 1),
  {name}_applied AS (
    SELECT text_id, list(CASE WHEN h.pos IS NULL THEN r.a ELSE r.a || '_' || r.b END ORDER BY r.pos) AS tokens
    FROM {name}_rows r LEFT JOIN {name}_taken h USING (text_id, pos)
    WHERE NOT EXISTS (SELECT 1 FROM {name}_taken e WHERE e.text_id = r.text_id AND e.pos = r.pos - 1)
    GROUP BY text_id)"""


BIGRAMS = f"{TOKENS}, {_grams_sql('bi', 'tokens')}"


@query(
    "bigram_scores",
    f"WITH {BIGRAMS} SELECT a, b, phrase, n_a, n_b, n_ab, round(score, 6) AS score FROM bi_phrases",
)
def bigram_scores(spark, sf):
    return corpus.phrase_scores(token_table(spark, sf)).withColumn("score", F.round("score", 6))


@query(
    "pair_counts",
    f"WITH {BIGRAMS} SELECT a, b, count(*) AS n FROM bi_rows WHERE b IS NOT NULL GROUP BY 1, 2",
)
def pair_counts(spark, sf):
    return corpus.gram_counts(tokens(spark, sf)).filter("b IS NOT NULL")


@query(
    "phrase_apply",
    f"""WITH {BIGRAMS}, {_applied_sql('bi')}, {_grams_sql('tri', 'bi_applied')}, {_applied_sql('tri')},
    kept AS (SELECT text_id, coalesce(tokens, []) AS tokens FROM texts LEFT JOIN tri_applied USING (text_id))
    SELECT {JOINED} FROM kept""",
)
def phrase_apply(spark, sf):
    return joined(corpus.with_phrases(tokens(spark, sf).select("text_id", "tokens")))


@query(
    "normal_forms",
    f"""WITH {TOKENS}, normal AS (
      SELECT text_id, list_transform(tokens, lambda t: CASE WHEN length(t) > 6 AND suffix(t, 'ing') THEN left(t, length(t) - 3) ELSE t END) AS tokens
      FROM tokens)
    SELECT {JOINED} FROM normal""",
)
def normal_forms(spark, sf):
    prepared = token_table(spark, sf)
    long_forms = prepared.select(F.explode("tokens").alias("token")).distinct()
    mapping = long_forms.filter((F.length("token") > 6) & F.col("token").endswith("ing")).select(
        F.lit("en").alias("lang"), "token", F.expr("left(token, length(token) - 3)").alias("norm")
    )
    return joined(corpus.map_tokens(prepared, mapping, "en"))


DUCK = Dialect(
    lambda word, pattern: f"regexp_matches({word}, '{pattern}')",
    lambda word, pattern: f"regexp_extract({word}, '{pattern}', 0)",
    lambda word, pattern, new: "regexp_replace({}, '{}', '{}', 'g')".format(word, pattern, new.replace("$", "\\")),
)
LETTER_WORDS = f"""{TEXTS}, words AS MATERIALIZED (
  SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}]+', ' ', 'g'), ' ')) AS token FROM texts)"""


def _stems_sql(language: str, source: str, name: str) -> str:
    """CTEs, one for each step of a language's rules; the last has (token, stem)."""
    tables, before = [], source
    for i, (column, sql) in enumerate(STEMMERS[language](DUCK)):
        tables.append(f"{name}{i} AS MATERIALIZED (SELECT *, {sql} AS {column} FROM {before})")
        before = f"{name}{i}"
    return ", ".join([*tables, f"{name} AS (SELECT token, stem FROM {before})"])


@query(
    "word_stems",
    f"WITH {LETTER_WORDS}, " + ", ".join(_stems_sql(g, "words", g) for g in STEMMERS) + " " + " UNION ALL ".join(f"SELECT '{g}' AS lang, token, stem FROM {g}" for g in STEMMERS),
)
def word_stems(spark, sf):
    """Every word of the texts under the rules of each language."""
    found = texts(spark, sf).select(F.explode(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}]+", " "), " ")).alias("token"))
    words = snapshot(found.distinct(), "words")
    return reduce(DataFrame.unionAll, [stems(words, g).select(F.lit(g).alias("lang"), "token", "stem") for g in STEMMERS])


@query(
    "stemmed_texts",
    f"""WITH {TOKENS}, words AS MATERIALIZED (SELECT DISTINCT unnest(tokens) AS token FROM tokens), {_stems_sql("en", "words", "en")},
    placed AS (SELECT text_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM tokens),
    stemmed AS (SELECT text_id, list(stem ORDER BY pos) AS tokens FROM placed JOIN en USING (token) GROUP BY 1),
    kept AS (SELECT text_id, coalesce(stemmed.tokens, []) AS tokens FROM texts LEFT JOIN stemmed USING (text_id))
    SELECT {JOINED} FROM kept""",
)
def stemmed_texts(spark, sf):
    """All tokens of all texts replaced by their English stems."""
    return joined(corpus.normalize_tokens(token_table(spark, sf), "stemming", None, "en"))


LANGUAGES = {
    "en": ["the", "and", "of", "is", "by", "with", "are", "was"],
    "fr": ["le", "la", "que", "qui", "une", "et", "des", "pour"],
    "de": ["und", "die", "der", "das", "ist", "mit", "den"],
    "es": ["el", "los", "las", "una", "por", "con", "del", "y"],
}


def _language_sql() -> str:
    hits = ", ".join(
        f"len(list_filter(w, lambda t: list_contains({listed}, t))) AS {lang}" for lang, listed in LANGUAGES.items()
    )
    best = "greatest(en, fr, de, es)"
    cases = " ".join(f"WHEN {lang} = {best} THEN '{lang}'" for lang in LANGUAGES)
    return f"""WITH {TEXTS}, w AS (
      SELECT text_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS w FROM texts),
      hits AS (SELECT text_id, {hits} FROM w)
    SELECT text_id, CASE WHEN {best} = 0 THEN NULL {cases} END AS detected FROM hits"""


@query("language_guess", _language_sql())
def language_guess(spark, sf):
    return corpus.with_language(texts(spark, sf), LANGUAGES).select("text_id", "detected")


GRAMS = """grams AS (
    SELECT text_id, post_language, substr(' ' || w || ' ', unnest(range(1, length(w) + 1)), 3) AS gram FROM (
      SELECT text_id, post_language, unnest(string_split(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g'), ' ')) AS w FROM texts) WHERE w <> '')"""


@query(
    "language_model",
    f"""WITH {TEXTS}, {GRAMS},
    counts AS MATERIALIZED (SELECT post_language AS lang, gram, count(*) AS n FROM grams WHERE text_id % 3 <> 0 GROUP BY 1, 2),
    totals AS (SELECT lang, round(1000000 * ln(0.5 / (sum(n) + 0.5 * (SELECT count(DISTINCT gram) FROM counts))))::BIGINT AS base FROM counts GROUP BY 1),
    gains AS (SELECT lang, gram, round(1000000 * ln((n + 0.5) / 0.5))::BIGINT AS gain FROM counts),
    mine AS (SELECT text_id, gram, count(*) AS n FROM grams GROUP BY 1, 2),
    sizes AS (SELECT text_id, sum(n) AS n FROM mine GROUP BY 1),
    hits AS (SELECT text_id, lang, sum(mine.n * gain) AS gain FROM mine JOIN gains USING (gram) GROUP BY 1, 2),
    scores AS (SELECT s.text_id, t.lang, coalesce(h.gain, 0) + s.n * t.base AS score
      FROM sizes s CROSS JOIN totals t LEFT JOIN hits h ON h.text_id = s.text_id AND h.lang = t.lang),
    best AS (SELECT text_id, lang, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, lang) AS place FROM scores)
    SELECT text_id, post_language, lang AS detected FROM texts LEFT JOIN (SELECT * FROM best WHERE place = 1) USING (text_id)""",
)
def language_model(spark, sf):
    """Profiles learned from two thirds of the texts, and the language of every text."""
    from threadlens.operators.languages import detect_languages, learn_profiles

    rows = texts(spark, sf)
    profiles = learn_profiles(rows.where("text_id % 3 <> 0"), "text", "post_language")
    return rows.select("text_id", "post_language").join(detect_languages(rows, profiles), "text_id")


@query(
    "texts_in_language",
    f"SELECT text_id, post_language FROM ({_language_sql()}) JOIN (SELECT doc_id AS text_id, lang AS post_language FROM documents) USING (text_id) WHERE detected = post_language",
)
def texts_in_language(spark, sf):
    from threadlens.operators.selection import in_language

    guessed = corpus.with_language(texts(spark, sf), LANGUAGES)
    return in_language(guessed, "detected", F.col("post_language")).select("text_id", "post_language")


LEXICON = {"the": 0.1, "and": 0.2, "that": -0.4, "les": 1.5, "que": -0.6, "eau": 0.9, "und": -0.2, "die": 0.3, "los": -1.0}


@query(
    "sentiment_labels",
    f"""WITH {TEXTS}, lexicon(word, valence) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())}),
    w AS (SELECT text_id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'), ' ')) AS word FROM texts),
    s AS (SELECT text_id, sum(valence) AS total FROM w JOIN lexicon USING (word) GROUP BY 1),
    c AS (SELECT text_id, total / sqrt(total * total + 15) AS compound FROM texts LEFT JOIN s USING (text_id))
    SELECT text_id, round(compound, 6) AS compound, CASE WHEN compound IS NULL THEN 'unknown' WHEN compound >= 0.05 THEN 'positive'
      WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""",
)
def sentiment_labels(spark, sf):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    labelled = corpus.sentiment_labels(texts(spark, sf), lexicon)
    return labelled.select("text_id", F.round("compound", 6).alias("compound"), "sentiment")


# Words of the texts in the part of intensifiers and negations, so that every rule meets them.
CONTEXT_BOOSTERS = {"of": 0.293, "to": 0.293, "in": -0.293, "de": -0.293, "in the": -0.293, "of the": -0.293}
CONTEXT_NEGATIONS = ["is", "not", "never", "was", "la", "mit"]
BOOST_SQL = "CASE " + " ".join(f"WHEN {{0}} = '{w}' THEN {v}::DOUBLE" for w, v in CONTEXT_BOOSTERS.items()) + " END"
SIGN_SQL = "(CASE WHEN v < 0 THEN -1 ELSE 1 END)"


def _turn_sql(place: int) -> str:
    a, b, c = "coalesce(lower(p1), '')", "coalesce(lower(p2), '')", "coalesce(lower(p3), '')"
    me = [a, b, c][place - 1]
    never = {1: "false", 2: f"{b} = 'never' AND {a} IN ('so', 'this')", 3: f"{c} = 'never' AND ({b} IN ('so', 'this') OR {a} IN ('so', 'this'))"}[place]
    doubt = {1: "false", 2: f"{b} = 'without' AND {a} = 'doubt'", 3: f"{c} = 'without' AND ({b} = 'doubt' OR {a} = 'doubt')"}[place]
    negated = f"{me} IN ({', '.join(repr(w) for w in CONTEXT_NEGATIONS)}) OR contains({me}, 'n''t')"
    return f"CASE WHEN {never} THEN 1.25 WHEN {doubt} THEN 1 WHEN {negated} THEN -0.74 ELSE 1 END"


def _neighbour_sql(place: int, before: str) -> str:
    word = f"p{place}"
    weight = f"({BOOST_SQL.format(f'lower({word})')} * {SIGN_SQL} + CASE WHEN {word} = upper({word}) AND {word} <> lower({word}) AND mixed THEN CASE WHEN v > 0 THEN 0.733 ELSE -0.733 END ELSE 0 END)"
    phrases = ""
    if place == 3:
        grams = ["lower(p3) || ' ' || lower(p2) || ' ' || lower(p1)", "lower(p3) || ' ' || lower(p2)", "lower(p2) || ' ' || lower(p1)"]
        phrases = "".join(f" + coalesce({BOOST_SQL.format(f'({g})')}, 0)" for g in grams)
    moved = f"(v + coalesce({weight} * {(1.0, 0.95, 0.9)[place - 1]}, 0)) * {_turn_sql(place)}{phrases}"
    return f"n{place} AS (SELECT * EXCLUDE (v), CASE WHEN {word} IS NOT NULL AND lower({word}) NOT IN (SELECT word FROM lexicon) THEN {moved} ELSE v END AS v FROM {before})"


@query(
    "sentiment_in_context",
    f"""WITH {TEXTS}, lexicon(word, base) AS (VALUES {", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON.items())}),
    split AS (SELECT text_id, text, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM texts),
    bare AS (SELECT text_id, text, list_transform(ws, lambda w: CASE WHEN length(regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g')) <= 2 THEN w
      ELSE regexp_replace(w, '^[!-/:-@\\[-`{{-~]+|[!-/:-@\\[-`{{-~]+$', '', 'g') END) AS ws FROM split),
    flags AS (SELECT *, len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w))) AS caps, list_position(list_transform(ws, lambda w: lower(w)), 'but') AS but FROM bare),
    placed AS (SELECT text_id, caps > 0 AND caps < len(ws) AS mixed, coalesce(but, 0) AS but, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM flags),
    around AS (SELECT *, lag(w, 1) OVER t AS p1, lag(w, 2) OVER t AS p2, lag(w, 3) OVER t AS p3, lead(w) OVER t AS nx FROM placed WINDOW t AS (PARTITION BY text_id ORDER BY pos)),
    hit AS (SELECT *, lower(w) AS word FROM around JOIN lexicon ON lower(w) = word),
    based AS (SELECT *, CASE WHEN lower(p1) = 'no' OR lower(p2) = 'no' OR (lower(p3) = 'no' AND lower(p1) IN ('or', 'nor')) THEN base * -0.74
      WHEN lower(w) = 'no' AND lower(nx) IN (SELECT word FROM lexicon) THEN 0 ELSE base END AS v0 FROM hit),
    n0 AS (SELECT *, v0 + CASE WHEN w = upper(w) AND w <> lower(w) AND mixed THEN CASE WHEN v0 < 0 THEN -0.733 ELSE 0.733 END ELSE 0 END AS v FROM based),
    {_neighbour_sql(1, "n0")}, {_neighbour_sql(2, "n1")}, {_neighbour_sql(3, "n2")},
    last AS (SELECT text_id, CASE WHEN {BOOST_SQL.format("lower(w)")} IS NOT NULL OR (lower(w) = 'kind' AND lower(nx) = 'of') THEN 0
      WHEN lower(p1) = 'least' AND lower(p1) NOT IN (SELECT word FROM lexicon) AND coalesce(lower(p2), '') NOT IN ('at', 'very') THEN v * -0.74 ELSE v END
      * CASE WHEN but > 0 AND pos < but THEN 0.5 WHEN but > 0 AND pos > but THEN 1.5 ELSE 1 END AS v FROM n3),
    sums AS (SELECT text_id, sum(v) AS s FROM last GROUP BY 1),
    marks AS (SELECT text_id, length(text) - length(replace(text, '!', '')) AS e, length(text) - length(replace(text, '?', '')) AS q FROM texts),
    stressed AS (SELECT text_id, s, least(e, 4) * 0.292 + CASE WHEN q <= 1 THEN 0 WHEN q <= 3 THEN q * 0.18 ELSE 0.96 END AS m FROM marks LEFT JOIN sums USING (text_id)),
    c AS (SELECT text_id, CASE WHEN s > 0 THEN s + m WHEN s < 0 THEN s - m ELSE s END AS t FROM stressed)
    SELECT text_id, round(t / sqrt(t * t + 15) + 3e-11, 9) AS compound, CASE WHEN t IS NULL THEN 'unknown' WHEN t / sqrt(t * t + 15) >= 0.05 THEN 'positive'
      WHEN t / sqrt(t * t + 15) <= -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""",
)
def sentiment_in_context(spark, sf):
    from threadlens.operators import sentiment

    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")
    found = sentiment.sentiment_in_context(texts(spark, sf), lexicon, boosters=CONTEXT_BOOSTERS, negations=CONTEXT_NEGATIONS)
    return found.withColumn("compound", rounded("compound"))
