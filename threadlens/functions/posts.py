"""Scalar expressions over post and comment fields."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide the post type and must be exactly these.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".gif"]
GIFV_SUFFIX = ".gifv"
VIDEO_HOST = "v.redd.it"
VIDEO_SUFFIX = ".mp4"
GALLERY_PREFIX = "https://www.reddit.com/gallery/"

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"
DAY_FIRST = "dd-MM-yyyy"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def combine_text(title: str | Column, text: str | Column, null_safe: bool = True) -> Column:
    """Title, a space and the text. Not null-safe means null when either part is null."""
    title, text = col(title), col(text)
    if null_safe:
        title, text = F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))
    return F.concat(title, F.lit(" "), text)


def post_type(is_self: str | Column, url: str | Column) -> Column:
    """Class of a post by its URL, case-sensitive; the first match wins."""
    url = col(url)
    image = F.lit(False)
    for suffix in IMAGE_SUFFIXES:
        image = image | url.endswith(suffix)
    return (
        F.when(col(is_self), "text")
        .when(image, "image")
        .when(url.endswith(GIFV_SUFFIX), "gifv")
        .when(url.contains(VIDEO_HOST) | url.endswith(VIDEO_SUFFIX), "video")
        .when(url.startswith(GALLERY_PREFIX), "gallery")
        .otherwise("link")
    )


def epoch_to_timestamp(seconds: str | Column) -> Column:
    return F.timestamp_seconds(col(seconds))


def epoch_to_iso(seconds: str | Column) -> Column:
    return F.date_format(epoch_to_timestamp(seconds), ISO_SECONDS)


def epoch_to_date(seconds: str | Column) -> Column:
    return F.to_date(epoch_to_timestamp(seconds))


def parse_day(text: str | Column, strict: bool = False) -> Column:
    """``DD-MM-YYYY`` text as a timestamp; bad input is null, or an error when strict."""
    return F.to_timestamp(col(text), DAY_FIRST) if strict else F.try_to_timestamp(col(text), F.lit(DAY_FIRST))


def parse_iso(text: str | Column, is_timestamp: bool = False) -> Column:
    """ISO text as a timestamp; a column that already is one passes through."""
    return col(text) if is_timestamp else F.to_timestamp(col(text))


def text_length(text: str | Column) -> Column:
    """Length in characters (code points)."""
    return F.length(col(text))


def author_name(author: str | Column) -> Column:
    """Name field of an author struct, null for a deleted account."""
    return col(author).getField("name")


def bare_parent_id(parent_id: str | Column) -> Column:
    """Parent id without its kind prefix (``t1_abc`` gives ``abc``)."""
    return F.split_part(col(parent_id), F.lit("_"), F.lit(2))


def description_or_empty(description: str | Column) -> Column:
    return F.coalesce(col(description), F.lit(""))


def is_self_comment(post_author: str | Column, comment_author: str | Column) -> Column:
    """Whether a comment is by the post's author; a missing author on either side means no."""
    return F.coalesce(col(post_author) == col(comment_author), F.lit(False))


def flag_text(flag: str | Column) -> Column:
    """A boolean as the words ``True`` and ``False``."""
    return F.when(col(flag), "True").otherwise("False")


def thread_node_size(upvotes: str | Column) -> Column:
    """Drawing size of a post node: ten plus twenty times the log of its votes."""
    return 10 + 20 * F.ln(F.greatest(col(upvotes).cast("double"), F.lit(1.0)))


# Colour of a node by sentiment.
SENTIMENT_COLORS = {"positive": "#1B9E77", "negative": "#ec7215"}
NEUTRAL_COLOR = "#97c2fc"


def sentiment_color(sentiment: str | Column) -> Column:
    chain = F
    for label, color in SENTIMENT_COLORS.items():
        chain = chain.when(col(sentiment) == label, color)
    return chain.otherwise(NEUTRAL_COLOR)


def topic_label(topic_id: str | Column, words: str | Column) -> Column:
    """``Topic n`` and its ``word:prob`` list, from an array of (word, prob) structs."""
    parts = F.transform(
        col(words), lambda w: F.format_string("%s:%.2f", w.getField("word"), w.getField("prob"))
    )
    return F.concat(
        F.lit("Topic "), (col(topic_id) + 1).cast("string"), F.lit("\n"), F.array_join(parts, ", ")
    )


def author_label(author: str | Column, score: str | Column) -> Column:
    name = F.coalesce(col(author), F.lit("None"))
    return F.concat(name, F.format_string("\n(Score: %.2f)", col(score)))


def author_node_size(score: str | Column) -> Column:
    return F.round(col(score), 2) + 10


def critical_z(alpha: float = 1e-6) -> float:
    """Two-sided critical value of the normal distribution."""
    return abs(NormalDist().inv_cdf(alpha / 2))


# Language codes the text operators accept.
LANGUAGE_NAMES = {
    "da": "danish",
    "de": "german",
    "el": "greek",
    "en": "english",
    "es": "spanish",
    "fi": "finnish",
    "fr": "french",
    "hu": "hungarian",
    "it": "italian",
    "nl": "dutch",
    "pt": "portuguese",
    "ro": "romanian",
    "sl": "slovene",
    "sv": "swedish",
}


def language_name(code: str) -> str:
    if code not in LANGUAGE_NAMES:
        raise ValueError(f"unknown language code {code!r}")
    return LANGUAGE_NAMES[code]


def language_name_column(code: str | Column) -> Column:
    pairs = [F.lit(part) for item in LANGUAGE_NAMES.items() for part in item]
    unknown = F.raise_error(F.concat(F.lit("unknown language code "), col(code)))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(code)), unknown.cast("string"))


def literal_structs(rows: Sequence[dict]) -> Column:
    """A small parameter list as an array of structs inside the expression."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])
