"""Sentiment of a text from a valence table and what stands around each of its words.

Every word that the table knows is weighed by its neighbours: an intensifier before it adds or takes, a negation turns it
round, capitals stress it, what follows "but" counts more than what precedes it, and exclamation and question marks
stress the whole. A word travels with its three predecessors and its successor, so the words of a text need not
meet again: known words come out of one join, and their valences are summed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.runtime import snapshot

# The published weights, intensifiers and negations.
STRONGER, CAPITALS, NEGATED = 0.293, 0.733, -0.74
FADING = (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION, EXCLAMATIONS, QUESTION, QUESTIONS, MANY_QUESTIONS = 0.292, 4, 0.18, 3, 0.96
MORE_WORDS = """absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially
  exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking fricking frickin frigging friggin fully greatly
  hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially
  thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very""".split()
LESS_WORDS = """almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely
  slight slightly somewhat sorta sortof sort-of""".split()
LESS_PHRASES = ["just enough", "kind of", "sort of"]
BOOSTERS = dict.fromkeys(MORE_WORDS, STRONGER) | dict.fromkeys([*LESS_WORDS, *LESS_PHRASES], -STRONGER)
NEGATIONS = """aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt
  mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt
  shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom
  despite""".split()
PUNCTUATION = r"[!-/:-@\[-`{-~]+"


def stripped_words(text: str | Column) -> Column:
    """Words at white space without punctuation around them; what would be two characters or fewer stays whole."""
    return F.transform(
        tx.words(text),
        lambda w: tx.bind(F.regexp_replace(w, rf"^{PUNCTUATION}|{PUNCTUATION}$", ""), lambda s: F.when(F.length(s) <= 2, w).otherwise(s)),
    )


def _capital(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def _booster(word: Column, boosters: Mapping[str, float]) -> Column:
    """The weight of an intensifier; null for any other word."""
    groups: dict[float, list[str]] = {}
    for name, weight in boosters.items():
        groups.setdefault(weight, []).append(name)
    found = [F.when(word.isin(names), F.lit(weight)) for weight, names in groups.items()]
    return F.coalesce(*found, F.lit(None).cast("double"))


def emphasis(text: str | Column) -> Column:
    """What exclamation and question marks add."""
    text = F.col(text) if isinstance(text, str) else text
    count = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    asked = count("?")
    questions = F.when(asked <= 1, 0.0).when(asked <= QUESTIONS, asked * QUESTION).otherwise(MANY_QUESTIONS)
    return F.least(count("!"), F.lit(EXCLAMATIONS)) * EXCLAMATION + questions


def word_valences(
    df: DataFrame, lexicon: DataFrame, key: str = "text_id", text: str = "text", boosters: Mapping[str, float] = BOOSTERS, negations: Sequence[str] = NEGATIONS
) -> DataFrame:
    """(key, pos, word, valence) of every known word, weighed by its neighbours."""
    lexicon = snapshot(lexicon.groupBy(F.lower("word").alias("word")).agg(F.max("valence").cast("double").alias("base")), "lexicon")
    words = df.select(F.col(key), stripped_words(text).alias("words")).where(F.col("words").isNotNull())
    none = F.lit(None).cast("string")
    moved = lambda n: F.concat(F.array(*[none] * n), F.col("words"))
    capitals = F.size(F.filter("words", _capital))
    # once a text, before its words part
    whole = words.select(
        key,
        ((capitals > 0) & (capitals < F.size("words"))).alias("mixed"),
        F.array_position(F.transform("words", F.lower), "but").alias("but"),
        F.arrays_zip(F.col("words").alias("w"), moved(1).alias("p1"), moved(2).alias("p2"), moved(3).alias("p3"), F.slice("words", 2, 2**31 - 1).alias("next")).alias("around"),
    )
    rows = whole.select(key, "mixed", "but", F.posexplode("around").alias("pos", "s"))
    rows = rows.select(key, "mixed", "but", (F.col("pos") + 1).alias("pos"), "s.*", F.lower("s.w").alias("word")).join(lexicon, "word")
    known = lexicon.select(F.col("word").alias("_known"))
    for name in ("p1", "p2", "p3", "next"):
        seen = known.select("_known", F.lit(True).alias(f"{name}_known"))
        rows = rows.join(seen, F.lower(name) == F.col("_known"), "left").drop("_known")

    low = {name: F.coalesce(F.lower(name), F.lit("")) for name in ("p1", "p2", "p3", "next")}
    value, sign = F.col("base"), lambda v: F.when(v < 0, -1.0).otherwise(1.0)
    value = F.when((F.col("word") == "no") & F.col("next_known"), 0.0).otherwise(value)
    no = (low["p1"] == "no") | (low["p2"] == "no") | ((low["p3"] == "no") & low["p1"].isin("or", "nor"))
    value = F.when(no, F.col("base") * NEGATED).otherwise(value)
    value = F.when(_capital(F.col("w")) & F.col("mixed"), value + sign(value) * CAPITALS).otherwise(value)
    rows = rows.withColumn("valence", value)

    negated = lambda name: low[name].isin(list(negations)) | F.contains(low[name], F.lit("n't"))
    twice = lambda a, b: a.isin("so", "this") | b.isin("so", "this")
    empty = F.lit("")
    turns = {
        "p1": F.when(negated("p1"), NEGATED),
        "p2": F.when((low["p2"] == "never") & twice(low["p1"], empty), 1.25).when((low["p2"] == "without") & (low["p1"] == "doubt"), 1.0).when(negated("p2"), NEGATED),
        "p3": F.when((low["p3"] == "never") & twice(low["p2"], low["p1"]), 1.25)
        .when((low["p3"] == "without") & ((low["p2"] == "doubt") | (low["p1"] == "doubt")), 1.0)
        .when(negated("p3"), NEGATED),
    }
    phrases = [F.concat_ws(" ", low["p3"], low["p2"], low["p1"]), F.concat_ws(" ", low["p3"], low["p2"]), F.concat_ws(" ", low["p2"], low["p1"])]
    for fading, (name, turn) in zip(FADING, turns.items(), strict=True):
        value = F.col("valence")
        weight = _booster(low[name], boosters) * sign(value)
        weight = F.when(_capital(F.col(name)) & F.col("mixed"), weight + F.when(value > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(weight)
        moved_on = (value + F.coalesce(weight * fading, F.lit(0.0))) * F.coalesce(turn, F.lit(1.0))
        if name == "p3":
            moved_on = reduce(lambda total, phrase: total + F.coalesce(_booster(phrase, boosters), F.lit(0.0)), phrases, moved_on)
        # a word of the table before this one has spoken for itself
        rows = rows.withColumn("valence", F.when(F.col(name).isNotNull() & F.col(f"{name}_known").isNull(), moved_on).otherwise(value))
    least = (low["p1"] == "least") & F.col("p1_known").isNull() & ~low["p2"].isin("at", "very")
    value = F.when(least, F.col("valence") * NEGATED).otherwise(F.col("valence"))
    silent = _booster(F.col("word"), boosters).isNotNull() | ((F.col("word") == "kind") & (low["next"] == "of"))
    value = F.when(silent, 0.0).otherwise(value)
    value = value * F.when((F.col("but") > 0) & (F.col("pos") < F.col("but")), BEFORE_BUT).when((F.col("but") > 0) & (F.col("pos") > F.col("but")), AFTER_BUT).otherwise(1.0)
    return rows.select(key, "pos", "word", value.alias("valence"))


def sentiment_in_context(
    df: DataFrame, lexicon: DataFrame, key: str = "text_id", text: str = "text", boosters: Mapping[str, float] = BOOSTERS, negations: Sequence[str] = NEGATIONS
) -> DataFrame:
    """(key, compound, sentiment), one row per key; texts without a known word have a null compound and are unknown.

    Keys name texts: rows that repeat a key with its text add nothing.
    """
    texts = df.select(key, text).dropDuplicates([key])
    sums = word_valences(texts, lexicon, key, text, boosters, negations).groupBy(key).agg(F.sum("valence").alias("_sum"))
    marks = texts.select(key, emphasis(text).alias("_marks"))
    total = F.when(F.col("_sum") > 0, F.col("_sum") + F.col("_marks")).when(F.col("_sum") < 0, F.col("_sum") - F.col("_marks")).otherwise(F.col("_sum"))
    scored = marks.join(sums, key, "left").withColumn("compound", tx.compound_valence(total))
    return scored.select(key, "compound", tx.sentiment_class("compound").alias("sentiment"))
