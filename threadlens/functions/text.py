"""Text expressions: cleaning, tokens, stop words, language and sentiment scores.

Everything here stays on the JVM and is linear in the text: stop-word tests are
``isin`` over literals, which Spark evaluates as one hash-set lookup per token.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from threadlens.functions.posts import col, language_name

# Fixed value: the white space that ends an address, spelled out so that engines
# with ASCII-only \S agree.
SPACES = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# Fixed value: what cleaning replaces by a space (addresses, mentions, and every
# run that is not an ASCII letter or digit, so accents and underscores split words).
NOISE = rf"(?:@|http?://|https?://|www)[^{SPACES}]+|[^A-Za-z0-9]+"

# Contracted forms that are two tokens each.
CONTRACTIONS = [
    ("can", "not"),
    ("gim", "me"),
    ("gon", "na"),
    ("got", "ta"),
    ("lem", "me"),
    ("wan", "na"),
]


# Fixed value: [^A-Za-z0-9]+ as Java's named class, for which it is over ten times faster than for the negated ranges.
NO_ALNUM = r"\P{Alnum}+"


def clean_text(text: str | Column) -> Column:
    """NOISE as spaces; a text in which no address or mention can start needs the plain part of the pattern only."""
    text = col(text)
    marked = F.contains(text, F.lit("@")) | F.contains(text, F.lit("://")) | F.contains(text, F.lit("www"))
    noise = NOISE.replace("[^A-Za-z0-9]+", NO_ALNUM)
    return F.when(marked, F.regexp_replace(text, noise, " ")).otherwise(F.regexp_replace(text, NO_ALNUM, " "))


def split_contractions(text: Column) -> Column:
    """Lower-case text with a space inside contracted forms, in one pass."""
    forms = "|".join(f"{first}(?={second}\\b)" for first, second in CONTRACTIONS)
    return F.regexp_replace(text, rf"\b({forms})", "$1 ")


def has_contractions(text: str | Column) -> Column:
    """Whether a contracted form can occur: plain substring tests, far cheaper than the pattern."""
    return _holds_contractions(F.lower(col(text)))


def _holds_contractions(lowered: Column) -> Column:
    found = F.lit(False)
    for first, second in CONTRACTIONS:
        found = found | F.contains(lowered, F.lit(first + second))
    return found


def words(text: str | Column) -> Column:
    """White-space separated words; an empty text gives an empty array."""
    return F.filter(F.split(col(text), r"\s+"), lambda w: w != "")


def text_tokens(
    text: str | Column, stopwords: Iterable[str] = (), min_length: int = 3, contractions: bool = True
) -> Column:
    """Clean, lower-case, tokenise, drop stop words and short tokens; null text gives null.

    The text is lower-cased as a whole (cleaned text is plain ASCII), and the
    contraction pattern runs only on texts that can match it, which are looked for in the cleaned text.
    """
    cleaned = F.lower(clean_text(text))
    if contractions:
        cleaned = bind(cleaned, lambda t: F.when(_holds_contractions(t), split_contractions(t)).otherwise(t))
    return keep_tokens(F.split(cleaned, " "), stopwords, min_length)


def keep_tokens(tokens: Column, stopwords: Iterable[str] = (), min_length: int = 3) -> Column:
    """Lower-case tokens that are long enough and not stop words."""
    stop = sorted({w.lower() for w in stopwords})
    shortest = max(min_length, 1)
    if not stop:
        return F.filter(tokens, lambda t: F.length(t) >= shortest)
    return F.filter(tokens, lambda t: (F.length(t) >= shortest) & ~t.isin(stop))


def keep_tokens_regex(tokens: Column, patterns: Sequence[str], min_length: int = 3) -> Column:
    """Like ``keep_tokens`` with stop words read as patterns; doubled backslashes are undone."""
    kept = keep_tokens(tokens, (), min_length)
    if not patterns:
        return kept
    joined = "|".join(f"(?:{p.strip().replace(chr(92) * 2, chr(92))})" for p in patterns)
    return F.filter(kept, lambda t: ~t.rlike(f"(?i)^(?:{joined})$"))


def plain_tokens(text: str | Column) -> Column:
    """Scoring tokens: lower case, split at white space, nothing removed."""
    return words(F.lower(col(text)))


# Fixed value: punctuation and clitic marks that end a word in uncleaned text. A period
# counts only where nothing but closing marks stands between it and white space.
WORD_ENDS = "|".join(
    [
        r"\.\.\.|--",
        r"[\[\](){}<>;@#$%&?!\"“”«»‘’`]",
        r"[:,](?![0-9])",
        r"'(?=(?:s|m|d|ll|re|ve)\b)",
        r"\.(?=[\s\])}>\"'”’»,;:?!]*(?:\s|$))",
    ]
)


def raw_text_tokens(text: str | Column) -> Column:
    """Lower-case word tokens of uncleaned text, with punctuation and clitics split off."""
    spaced = F.regexp_replace(F.lower(col(text)), WORD_ENDS, " ")
    spaced = F.regexp_replace(spaced, r"n't\b", " n't")
    return words(F.when(has_contractions(text), split_contractions(spaced)).otherwise(spaced))


def default_stopwords(spark: SparkSession, language: str) -> list[str]:
    """Spark's stop words of a language code; languages Spark lacks need a caller list."""
    from pyspark.ml.feature import StopWordsRemover

    name = language_name(language)
    try:
        return list(StopWordsRemover.loadDefaultStopWords(name))
    except Exception as error:
        raise ValueError(f"Spark has no stop words for {name}; pass a list") from error


def stop_hits(tokens: Column, stopwords: Iterable[str]) -> Column:
    listed = sorted({w.lower() for w in stopwords})
    return F.size(F.filter(tokens, lambda t: t.isin(listed)))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def guess_language(text: str | Column, stopwords_by_language: Mapping[str, Sequence[str]]) -> Column:
    """Language with the most stop-word hits; null without a hit, ties to the first listed."""
    tokens = F.split(F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", " "), " ")

    def best(found: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(
                        stop_hits(found, listed).alias("hits"),
                        F.lit(-i).alias("order"),
                        F.lit(language).alias("language"),
                    )
                    for i, (language, listed) in enumerate(stopwords_by_language.items())
                ]
            )
        )

    return bind(bind(tokens, best), lambda top: F.when(top.getField("hits") > 0, top.getField("language")))


# Fixed values of the published normalisation of a summed valence.
VALENCE_NORM = 15.0
SENTIMENT_CUT = 0.05


def compound_valence(total: str | Column) -> Column:
    total = col(total).cast("double")
    return total / F.sqrt(total * total + VALENCE_NORM)


def sentiment_class(compound: str | Column) -> Column:
    """Class of a normalised valence; null (no word of the lexicon) is unknown."""
    compound = col(compound)
    return (
        F.when(compound.isNull(), "unknown")
        .when(compound >= SENTIMENT_CUT, "positive")
        .when(compound <= -SENTIMENT_CUT, "negative")
        .otherwise("neutral")
    )


def contains_text(text: str | Column, needle: str | Column, ignore_case: bool = True) -> Column:
    text = col(text)
    needle = F.lit(needle) if isinstance(needle, str) else needle
    if ignore_case:
        return F.contains(F.lower(text), F.lower(needle))
    return F.contains(text, needle)
