"""Language detection by naive Bayes over letter trigrams.

Profiles are learned from labelled texts: counts by (language, word), then by (language, trigram). Texts are scored by a join of their
trigrams with the profiles, which partial sums reduce to one row a text before anything is shuffled. Logarithms are
whole millionths, so that sums, and with them ties, are the same in any order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.runtime import snapshot

#: Letters of a gram; what an unseen gram counts; units of a logarithm.
LETTERS, UNSEEN, UNITS = 3, 0.5, 1_000_000


class LanguageProfiles(NamedTuple):
    """Languages in order, what a gram adds to each without being known, and (gram, gains) by language."""

    languages: list[str]
    bases: list[int]
    gains: DataFrame


def letter_words(df: DataFrame, text: str, *keep: str | Column) -> DataFrame:
    """(…, word): lower-case runs of letters, one row each."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), " ")
    return df.select(*keep, F.explode(F.filter(words, lambda w: w != "")).alias("word"))


def letter_grams(words: DataFrame, *keep: str | Column) -> DataFrame:
    """(…, gram): trigrams of words, a space before and after each."""
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    places = F.sequence(F.lit(1), F.length("word"))
    return words.select(*keep, F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(LETTERS)))).alias("gram"))


def learn_profiles(labelled: DataFrame, text: str = "text", language: str = "language") -> LanguageProfiles:
    """Profiles of every language of the labelled texts; texts without a label take no part."""
    known = labelled.where(F.col(language).isNotNull())
    # words first: what is cut into grams is each word once
    words = letter_words(known, text, F.col(language).alias("language")).groupBy("language", "word").agg(F.count(F.lit(1)).alias("n"))
    counts = snapshot(letter_grams(words, "language", "n").groupBy("language", "gram").agg(F.sum("n").alias("n")), "letter-grams")
    totals = {r.language: r.n for r in counts.groupBy("language").agg(F.sum("n").alias("n")).collect()}  # a row a language
    languages = sorted(totals)
    different = counts.select("gram").distinct().count()
    unit = lambda value: F.round(UNITS * F.ln(value)).cast("long")
    bases = [unit(F.lit(UNSEEN) / F.lit(totals[g] + UNSEEN * different)) for g in languages]
    spark = labelled.sparkSession
    base = list(spark.range(1).select(*[b.alias(f"b{i}") for i, b in enumerate(bases)]).first()) if languages else []
    gain = lambda g: F.coalesce(F.sum(F.when(F.col("language") == g, unit((F.col("n") + UNSEEN) / UNSEEN))), F.lit(0).cast("long"))
    gains = counts.groupBy("gram").agg(F.array(*[gain(g) for g in languages]).cast("array<long>").alias("gains"))
    return LanguageProfiles(languages, base, snapshot(gains, "language-profiles"))


def detect_languages(df: DataFrame, profiles: LanguageProfiles, key: str = "text_id", text: str = "text") -> DataFrame:
    """(key, detected), one row per key: the likeliest language, ties to the first; null for a text without a letter."""
    keys = df.select(key).distinct()
    if not profiles.languages:
        return keys.withColumn("detected", F.lit(None).cast("string"))
    rows = letter_grams(letter_words(df, text, key), key).join(profiles.gains, "gram", "left")
    sums = [F.coalesce(F.sum(F.get("gains", F.lit(i))), F.lit(0)) + F.count(F.lit(1)) * base for i, base in enumerate(profiles.bases)]
    scored = rows.groupBy(key).agg(*[s.alias(f"_s{i}") for i, s in enumerate(sums)])
    best = F.array_max(F.array(*[F.struct(F.col(f"_s{i}").alias("score"), F.lit(-i).alias("order"), F.lit(g).alias("g")) for i, g in enumerate(profiles.languages)]))
    return keys.join(scored.select(key, best.getField("g").alias("detected")), key, "left")


def save_profiles(profiles: LanguageProfiles, path: str) -> None:
    """Profiles under one path, to be learned once and used by many runs."""
    spark = profiles.gains.sparkSession
    rows = [(i, g, b) for i, (g, b) in enumerate(zip(profiles.languages, profiles.bases, strict=True))]
    spark.createDataFrame(rows, "place int, language string, base long").coalesce(1).write.mode("overwrite").parquet(f"{path}/languages")
    profiles.gains.write.mode("overwrite").parquet(f"{path}/gains")


def load_profiles(spark: SparkSession, path: str) -> LanguageProfiles:
    rows = spark.read.parquet(f"{path}/languages").orderBy("place").collect()  # a row a language
    return LanguageProfiles([r.language for r in rows], [r.base for r in rows], spark.read.parquet(f"{path}/gains"))
