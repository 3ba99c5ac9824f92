"""Search for a table of terms of any size, by a trigram index.

A text that contains a term contains each of the term's trigrams. So every term waits at one of its trigrams, the one
that the fewest texts have; a text meets the terms that wait at its trigrams, and those candidates are verified.
Nothing is tested term by term, and what is joined grows with the candidates.

A term without a space is in a text if and only if it is in one of the words between the text's spaces. Such terms are
sought in the distinct words of all texts, each word once, and a text takes what its words hold. Only terms with a space
are sought in the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.runtime import snapshot

#: Letters of a gram; shorter terms wait at themselves.
LETTERS = 3
#: Lists in which a text's candidates are put together, so that no list holds all of very many terms.
LISTS = 16
#: Distinct words of a text that are put together at once; the words of a longer text are dealt to LISTS slices.
WORDS = 10_000
#: Letters of a word whose stretches are all looked up.
SHORT = 32


def _grams(text: Column, letters: int) -> Column:
    """Overlapping stretches of a text; one pass, however long it is."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{letters}}}))"), F.lit(1))


def waiting_terms(texts: DataFrame, needles: DataFrame, lowered: Sequence[Column]) -> tuple[DataFrame, list[int]]:
    """(gram, needle), one row a needle, and the lengths of the grams that occur."""
    own = F.when(F.length("needle") < LETTERS, F.array("needle")).otherwise(F.array_distinct(_grams(F.col("needle"), LETTERS)))
    index = snapshot(needles.select("needle", F.explode(own).alias("gram")), "term-grams")
    lengths = sorted(r.n for r in index.select(F.length("gram").alias("n")).distinct().collect())  # 0 to LETTERS
    grams = index.select("gram").distinct()
    counts = texts.select(F.explode(text_grams(lowered, lengths)).alias("gram")).join(grams, "gram").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = index.join(snapshot(counts, "gram-counts"), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best"))
    # a term with a gram that no text has is in none
    return snapshot(rare.where("best.n > 0").select("best.gram", "needle"), "waiting-terms"), lengths


def text_grams(lowered: Sequence[Column], lengths: Sequence[int]) -> Column:
    """Distinct grams of all text columns of a row; null texts have none."""
    none = F.array().cast("array<string>")
    parts = []
    for text in lowered:
        for n in lengths:
            found = _grams(text, n) if n else F.when(text.isNotNull(), F.array(F.lit("")))
            parts.append(F.coalesce(found, none))
    return F.array_distinct(F.concat(*parts)) if parts else none


def _meeting(rows: DataFrame, needles: DataFrame, lowered: Sequence[Column], key: str) -> DataFrame:
    """(key, _needles): the needles that are in any of the lowered columns of ``rows``, in several lists a row of ``rows``."""
    waiting, lengths = waiting_terms(rows, needles, lowered)
    # only keys and grams travel to the index; a text comes once to each list of its candidates
    met = rows.select(key, F.explode(text_grams(lowered, lengths)).alias("gram")).join(waiting, "gram")
    listed = met.groupBy(key, F.pmod(F.xxhash64("needle"), F.lit(LISTS)).alias("_list")).agg(F.collect_list("needle").alias("_needles")).drop("_list")
    found = rows.join(listed, key).select(key, F.filter("_needles", _held(lowered)).alias("_needles"))
    return found.where(F.size("_needles") > 0)


def _held(lowered: Sequence[Column]) -> Callable[[Column], Column]:
    """Whether a needle is in any of the lowered columns."""
    low = F.array(*lowered)
    return lambda needle: F.exists(low, lambda text: F.coalesce(F.contains(text, needle), F.lit(False)))


def _pieces(word: str, lengths: Sequence[int]) -> Column:
    """All stretches of a short word with one of the lengths."""

    def of(n: Column) -> Column:
        starts = F.when(n == 0, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.length(word) - n + 1))
        return F.transform(starts, lambda i: F.substring(F.col(word), i, n))

    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length(word))
    return F.array_distinct(F.flatten(F.transform(fitting, of)))


def _in_words(rows: DataFrame, needles: DataFrame, lowered: Sequence[Column], key: str) -> DataFrame:
    """(key, _ids) of needles (needle, _id) without a space, through the distinct words of all rows."""
    none = F.array().cast("array<string>")
    parts = [F.coalesce(F.split(text, " "), none) for text in lowered]
    own = rows.select(key, (F.array_distinct(F.concat(*parts)) if parts else none).alias("_words"))
    words = own.select(key, (F.size("_words") > WORDS).alias("_many"), F.explode("_words").alias("_word"))
    distinct = snapshot(words.select("_word").distinct(), "words")
    # all stretches of a short word meet the needles, a longer word goes by its grams
    short = F.length("_word") <= SHORT
    lengths = sorted(r.n for r in needles.select(F.length("needle").alias("n")).distinct().collect() if r.n <= SHORT)
    near = distinct.where(short).select("_word", F.explode(_pieces("_word", lengths)).alias("needle")).join(needles, "needle")
    far = _meeting(distinct.where(~short), needles.select("needle"), [F.col("_word")], "_word")
    far = far.select("_word", F.explode("_needles").alias("needle")).join(needles, "needle")
    held = near.select("_word", "_id").unionByName(far.select("_word", "_id"))
    held = snapshot(held.groupBy("_word", F.expr(f"_id div {WORDS}").alias("_list")).agg(F.collect_list("_id").alias("_ids")).drop("_list"), "words-with-terms")
    # a slice of 0 to LISTS - 1 for the words of long texts, one of its own for all words of the others
    part = F.when(F.col("_many"), F.pmod(F.xxhash64("_word"), F.lit(LISTS))).otherwise(F.lit(-1)).alias("_slice")
    met = words.join(held, "_word").groupBy(key, part).agg(F.array_distinct(F.flatten(F.collect_list("_ids"))).alias("_ids"))
    met = snapshot(met, "terms-of-texts")
    # slices of one text can hold the same needle
    sliced = snapshot(met.where(F.col("_slice") >= 0).select(key).distinct(), "long-texts")
    again = met.join(sliced, key, "left_semi").select(key, F.explode("_ids").alias("_id")).distinct()
    again = again.groupBy(key, F.pmod("_id", F.lit(LISTS)).alias("_list")).agg(F.collect_list("_id").alias("_ids"))
    return met.join(sliced, key, "left_anti").select(key, "_ids").unionByName(again.select(key, "_ids"))


def search_term_table(df: DataFrame, terms: DataFrame, texts: Sequence[str], key: str) -> DataFrame:
    """One row per row of ``df`` and row of ``terms`` whose ``term`` is in any of the text columns, whatever the case.

    ``key`` names the rows of ``df``; rows without a key find nothing, nor do terms that are null. The other
    columns of ``terms`` come along and must not be columns of ``df``.
    """
    clash = sorted(set(df.columns) & set(terms.columns))
    if clash:
        raise ValueError(f"columns of both tables: {clash}")
    asked = terms.where(F.col("term").isNotNull()).withColumn("_needle", F.lower("term"))
    # numbered and written once: numbers travel instead of terms
    needles = snapshot(asked.select(F.col("_needle").alias("needle")).distinct().withColumn("_id", F.monotonically_increasing_id()), "terms")
    asked = snapshot(asked.join(needles, F.col("_needle") == F.col("needle")).select(*terms.columns, "_needle", "_id"), "asked-terms")
    spaced = F.contains(F.col("needle"), F.lit(" "))
    lowered = [F.lower(F.col(c)) for c in texts]
    rows = df.select(key, *texts)
    listed = _in_words(rows, needles.where(~spaced), lowered, key)
    if not needles.where(spaced).isEmpty():
        met = _meeting(rows, needles.where(spaced).select("needle"), lowered, key).select(key, F.explode("_needles").alias("needle"))
        met = met.distinct().join(needles, "needle").groupBy(key, F.pmod("_id", F.lit(LISTS)).alias("_list"))
        listed = listed.unionByName(met.agg(F.collect_list("_id").alias("_ids")).drop("_list"))
    found = df.join(listed, key).select(*df.columns, F.explode("_ids").alias("_id")).join(asked, "_id")
    if not df.groupBy(key).count().where("count > 1").isEmpty():
        # what was found under a key need not be in each of its rows
        found = found.where(_held(lowered)(F.col("_needle")))
    return found.select(*df.columns, *terms.columns)
