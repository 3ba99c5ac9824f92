"""Quality rules: fixed repetition and length rules, then divergence from language references.

A document is described by two histograms: its characters over classes (lower case, upper case, digits,
white space, ...) and its words over common words, "any other" and "only marks". Both are compared with the reference
of the document's language, the summed histograms of **all** documents of that language, by the
Jensen-Shannon distance (base 2, 0 to 1). Every language of the table has a reference, however rare. A document
that states no language takes its nearest reference.
Below ``min_words`` words a histogram says too little and only the fixed rules decide.

Defined results: null text counts as empty (no words, ``base_failed``); a document that states a
language without a reference, or an empty reference table, is not rejected by divergence (distances 0); repeated rows are judged alike;
columns of the input that carry a result's name are replaced by the result.
"""

from __future__ import annotations

import string
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import SPACES, map_texts, parts

#: Common words of the languages, the bins of the word histogram.
COMMON_WORDS = """
the of and to in a is that it for on was be with as by this are at from or an not have you
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an
de la le et les des en un une que est pour qui dans a par plus pas au sur ne se du
de la que el en y a los se del las un por con no una su para es al lo como
""".split()

SYMBOLS = "#*$%&|<>"
CHAR_CLASSES = 9
CHAR_LIMIT, WORD_LIMIT, SUM_LIMIT, MIN_WORDS = 0.32, 0.52, 0.70, 50
WINDOW = 8

FIELDS = [
    ("n_words", "long", pa.int64()),
    ("word_chars", "long", pa.int64()),
    ("n_symbols", "long", pa.int64()),
    ("n_dup_lines", "long", pa.int64()),
    ("n_repeat_words", "long", pa.int64()),
    ("char_distance", "double", pa.float64()),
    ("word_distance", "double", pa.float64()),
    ("base_failed", "boolean", pa.bool_()),
    ("kept", "boolean", pa.bool_()),
]


def _class_table() -> np.ndarray:
    """Character class by code point; the last entry stands for all larger code points."""
    table = np.zeros(0x250, dtype=np.int8)
    for point in range(len(table)):
        c = chr(point)
        if c in SPACES:
            table[point] = 0
        elif c in "aeiou":
            table[point] = 1
        elif "a" <= c <= "z":
            table[point] = 2
        elif "A" <= c <= "Z":
            table[point] = 3
        elif c.isdigit():
            table[point] = 4
        elif c in SYMBOLS:
            table[point] = 5
        elif c.isalpha():
            table[point] = 6
        elif point < 128:
            table[point] = 7
        else:
            table[point] = 8
    table[-1] = 6
    return table


def _word_bins() -> dict[bytes, int]:
    """Written forms of the common words (case, one closing mark) to their bins."""
    bins = {}
    for i, word in enumerate(dict.fromkeys(COMMON_WORDS)):
        for form in (word, word.capitalize(), word.upper()):
            for mark in ("", ".", ",", ";", ":", "!", "?"):
                bins.setdefault((form + mark).encode(), i)
    for mark in string.punctuation:
        for count in (1, 2, 3):
            bins[mark.encode() * count] = MARKS
    return bins


BINS = len(dict.fromkeys(COMMON_WORDS)) + 2
OTHER, MARKS = BINS - 2, BINS - 1


def histograms(texts: list[str], words: list[list[bytes]], table: np.ndarray, bins: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of word bins, one row per text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    rows = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    classes = table[np.minimum(points, len(table) - 1)]
    chars = np.bincount(rows * CHAR_CLASSES + classes, minlength=len(texts) * CHAR_CLASSES)
    found = np.fromiter((bins.get(w, OTHER) for ws in words for w in ws), dtype=np.int64)
    rows = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    named = np.bincount(rows * BINS + found, minlength=len(texts) * BINS)
    return chars.reshape(-1, CHAR_CLASSES).astype(float), named.reshape(-1, BINS).astype(float)


def jensen_shannon(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Distance between each row of counts and one reference, or between rows; 0 to 1. No counts: 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    q = np.broadcast_to(reference / max(reference.sum(), 1), p.shape)
    m = (p + q) / 2

    def relative(x):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log2(x / m), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((relative(p) + relative(q)) / 2, 0, 1)), 0.0)


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, kind, bin, n): summed histograms of all documents with a language."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))
    table, bins = _class_table(), _word_bins()
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def flush():
            rows = [(g, kind, i, int(n)) for g, both in sums.items() for kind, values in zip(("char", "word"), both, strict=True) for i, n in enumerate(values) if n]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema) if rows else None

        for piece, texts in parts(batches, "_text"):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            chars, named = histograms(texts, words, table, bins)
            groups = np.array(piece.column(1).to_pylist(), dtype=object)
            for g in set(groups):
                mine = groups == g
                old = sums.get(g, (np.zeros(CHAR_CLASSES), np.zeros(BINS)))
                sums[g] = (old[0] + chars[mine].sum(axis=0), old[1] + named[mine].sum(axis=0))
            if len(sums) > 1000 and (made := flush()):
                yield made
        if made := flush():
            yield made

    return known.mapInArrow(run, "lang string, kind string, bin int, n long").groupBy("lang", "kind", "bin").agg(F.sum("n").alias("n"))


@dataclass
class References:
    """Histograms by language, about 1 KB each."""

    chars: dict[str, np.ndarray]
    words: dict[str, np.ndarray]


def load_references(table: DataFrame) -> References:
    """The references of all languages as arrays: two short histograms a language, whatever the number of documents."""
    found = References({}, {})
    by_lang = table.groupBy("lang", "kind").agg(F.collect_list(F.struct("bin", "n")).alias("bins"))  # BINS at most
    for row in by_lang.collect():
        kind, width = (found.chars, CHAR_CLASSES) if row["kind"] == "char" else (found.words, BINS)
        kind[row["lang"]] = np.zeros(width)
        for place, n in row["bins"]:
            kind[row["lang"]][place] = n
    return found


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside a window of ``width`` words that the text has at least twice, first occurrences included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, references: References, carry: dict, text: str = "text", lang: str = "lang", only_kept: bool = False,
          char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT, sum_limit: float = SUM_LIMIT, min_words: int = MIN_WORDS) -> DataFrame:
    """The counts, distances and verdict of every document beside ``carry``; with ``only_kept`` just ``carry`` of the kept."""
    table, bins = _class_table(), _word_bins()
    lang_at = len(carry)  # the language comes last among the carried columns

    def work(texts, piece):
        words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        chars, named = histograms(texts, words, table, bins)
        langs = np.array(piece.column(lang_at).to_pylist(), dtype=object)
        by_char, by_word = np.zeros(len(texts)), np.zeros(len(texts))
        known = np.array([g in references.chars and g in references.words for g in langs], dtype=bool)
        for g in {g for g, k in zip(langs, known, strict=True) if k}:
            mine = langs == g
            by_char[mine] = jensen_shannon(chars[mine], references.chars[g])
            by_word[mine] = jensen_shannon(named[mine], references.words[g])
        unstated = np.array([g is None for g in langs], dtype=bool)
        if unstated.any():
            best = np.full(int(unstated.sum()), np.inf)
            for g in sorted(references.chars.keys() & references.words.keys()):
                char, word = jensen_shannon(chars[unstated], references.chars[g]), jensen_shannon(named[unstated], references.words[g])
                nearer = np.flatnonzero(char + word < best)
                at = np.flatnonzero(unstated)[nearer]
                best[nearer], by_char[at], by_word[at] = (char + word)[nearer], char[nearer], word[nearer]
        n_words = np.array([len(w) for w in words])
        repeats = np.array([repeated_words(w) for w in words])
        failed = (n_words < 20) | (100 * repeats > 30 * n_words)
        kept = ~failed & ((n_words < min_words) | ((by_char <= char_limit) & (by_word <= word_limit) & (by_char + by_word <= sum_limit)))
        if only_kept:
            return [kept]
        return [
            n_words,
            [len(t) - sum(map(t.count, SPACES)) for t in texts],
            [sum(map(t.count, SYMBOLS)) for t in texts],
            [repeated_lines(t) for t in texts],
            repeats,
            by_char,
            by_word,
            failed,
            kept,
        ]

    free = "_lang"
    while free in carry:
        free += "_"
    carry = {**carry, free: F.col(lang).cast("string")}
    return map_texts(docs, text, carry, [] if only_kept else FIELDS, work, keep=only_kept).drop(free)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", references: References | None = None, **limits) -> DataFrame:
    """One row per document: key, counts, distances, ``base_failed`` and ``kept``."""
    references = references or load_references(language_references(docs, text, lang))
    return judge(docs, references, {key: key}, text, lang, **limits)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", references: References | None = None, **limits) -> DataFrame:
    """The documents that pass, with all their columns."""
    references = references or load_references(language_references(docs, text, lang))
    return judge(docs, references, {c: c for c in docs.columns}, text, lang, only_kept=True, **limits)
