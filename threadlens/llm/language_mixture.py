"""Language ID: each document is a mixture of languages, estimated by expectation-maximisation.

Training counts letter trigrams (hashed, non-letters are word ends) per language over **all** training rows, and
every language that has letters there is learned, however rare.
A word's likelihood under a language is the product over its trigrams. For each document EM estimates the
languages' shares of its words; then the language set is grown in the order of the shares while the
likelihood, penalised by log(words) / 2 for each further language, improves. The prediction is the largest
share in the set; ``score`` is its share in the mixture of all languages.

Defined results: ``und`` with score 0 and no languages for null or letterless text, and when nothing was
learned; equal shares go to the language first in the alphabet; copies get equal results. Input columns that
carry a result's name are replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_texts, parts

BUCKETS = 1 << 14
SMOOTHING = 0.5
ITERATIONS = 12
SETTLED = 1e-3
#: Languages whose counts cross the driver together.
TOGETHER = 20
UNKNOWN = "und"

FIELDS = [
    ("lang_pred", "string", pa.string()),
    ("score", "double", pa.float64()),
    ("languages", "array<struct<lang:string,share:double>>", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))),
]


def letter_table() -> np.ndarray:
    """True at the code points of letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per letter: its trigram's bucket. Per word: its first letter's index. Per word: its text."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[np.minimum(points, 0x10FFFF)]
    coded = np.where(is_letter, points, 32).astype(np.uint64)
    mixed = coded[:-2] * np.uint64(0x9E3779B1) + coded[1:-1] * np.uint64(0x85EBCA77) + coded[2:] * np.uint64(0xC2B2AE3D)
    at = np.flatnonzero(is_letter[1:-1])
    buckets = ((mixed[at] ^ (mixed[at] >> np.uint64(15))) & np.uint64(BUCKETS - 1)).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[at]
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    return buckets, first, owner[first]


def count_trigrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows with a language; summed in each task before the shuffle."""
    known = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("_text"), F.col(lang).cast("string").alias("_lang"))

    def run(batches):
        letters, sums = letter_table(), {}

        def flush():
            for g, counts in sorted(sums.items()):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], names=["lang", "bucket", "n"])
            sums.clear()

        for piece, texts in parts(batches, "_text"):
            buckets, first, owner = trigrams(texts, letters)
            if not len(first):
                continue
            groups, number = np.unique(np.array(piece.column(1).to_pylist(), dtype=object), return_inverse=True)
            of_letter = np.repeat(number[owner], np.diff(first, append=len(buckets)))
            for i, g in enumerate(groups):
                sums[g] = sums.get(g, 0) + np.bincount(buckets[of_letter == i], minlength=BUCKETS)
            if len(sums) > 200:
                yield from flush()
        yield from flush()

    return known.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Log probability of a trigram bucket (columns) under a language (rows)."""

    languages: list[str]
    log_p: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Fit on all rows of ``docs`` that have a language, and learn every one of them: ``BUCKETS`` floats a language."""
    from threadlens.runtime import snapshot

    counts = snapshot(count_trigrams(docs, text, lang), "trigrams")
    names = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    log_p = np.full((len(names), BUCKETS), SMOOTHING, dtype=np.float32)
    for start in range(0, len(names), TOGETHER):  # BUCKETS rows a language at most
        place = {name: i for i, name in enumerate(names[start : start + TOGETHER])}
        rows = counts.where(F.col("lang").isin(list(place))).toPandas()
        some = np.full((len(place), BUCKETS), SMOOTHING, dtype=np.float64)
        some[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy()
        log_p[start : start + TOGETHER] = np.log(some / some.sum(axis=1, keepdims=True))
    return Model(names, log_p)


def fit_shares(like: np.ndarray, first: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for the shares of ``allowed`` languages in each document; shares and log likelihoods.

    like: languages x words, each word's largest 1. first: each document's first word. owner: each word's
    document. A document drops out once its shares move by less than ``SETTLED``.
    """
    shares = (allowed / allowed.sum(axis=0)).astype(np.float32)
    live, own_like, own_first, of = np.arange(len(first)), like, first, owner
    for _ in range(ITERATIONS):
        now = shares[:, live]
        joint = own_like * now[:, of]
        joint /= np.maximum(joint.sum(axis=0), 1e-30)
        fresh = np.add.reduceat(joint, own_first, axis=1)
        fresh /= np.maximum(fresh.sum(axis=0), 1e-30)
        shares[:, live] = fresh
        moving = np.abs(fresh - now).max(axis=0) > SETTLED
        if not moving.any():
            break
        if moving.mean() < 0.7:
            words = moving[of]
            live, own_like = live[moving], own_like[:, words]
            of = (np.cumsum(moving) - 1)[of[words]]
            own_first = np.flatnonzero(np.diff(of, prepend=-1))
    return shares, likelihoods(like, first, owner, shares)


def likelihoods(like: np.ndarray, first: np.ndarray, owner: np.ndarray, shares: np.ndarray) -> np.ndarray:
    seen = (like * shares.astype(np.float32)[:, owner]).sum(axis=0)
    return np.add.reduceat(np.log(np.maximum(seen, 1e-30)).astype(np.float64), first)


def mixtures(texts: list[str], model: Model, letters: np.ndarray) -> list[tuple[str, float, list]]:
    """(language, score, language set with shares) of each text."""
    out: list = [(UNKNOWN, 0.0, [])] * len(texts)
    buckets, starts, owner = trigrams(texts, letters)
    if not len(starts) or not model.languages:
        return out
    like = np.stack([np.add.reduceat(column[buckets], starts) for column in model.log_p])
    like = np.exp(np.maximum(like - like.max(axis=0), -60))
    with_words, first, of = np.unique(owner, return_index=True, return_inverse=True)
    n_words, n_langs = np.diff(first, append=like.shape[1]), len(model.languages)
    penalty = np.log(np.maximum(n_words, 2)) / 2

    full, most = fit_shares(like, first, of, np.ones((n_langs, len(with_words))))
    order = np.argsort(-full, axis=0, kind="stable")
    rank = np.argsort(order, axis=0, kind="stable")
    chosen = (rank == 0).astype(np.float32)
    best, size = likelihoods(like, first, of, chosen), 1
    # the mixture of all languages bounds the likelihood of every set
    open_ = np.flatnonzero(most - penalty > best)
    while len(open_) and size < n_langs:
        place = np.full(len(with_words), -1)
        place[open_] = np.arange(len(open_))
        words = np.flatnonzero(place[of] >= 0)
        number = place[of[words]]
        begin = np.flatnonzero(np.diff(number, prepend=-1))
        shares, gained = fit_shares(like[:, words], begin, number, (rank[:, open_] <= size).astype(np.float32))
        better = gained - penalty[open_] > best[open_]
        open_, shares, gained = open_[better], shares[:, better], gained[better]
        best[open_] = gained
        chosen[:, open_] = shares
        open_ = open_[most[open_] - penalty[open_] > gained]
        size += 1
    for i, row in enumerate(with_words):
        kept = [(model.languages[j], float(chosen[j, i])) for j in order[:, i] if chosen[j, i] > 0]
        kept.sort(key=lambda x: (-x[1], x[0]))
        share = float(full[model.languages.index(kept[0][0]), i])
        out[row] = (kept[0][0], min(1.0, max(0.0, share)), [{"lang": g, "share": s} for g, s in kept])
    return out


def _mapped(docs: DataFrame, model: Model, carry: dict[str, str | Column], text: str, min_score: float | None) -> DataFrame:
    held = {}

    def work(texts, piece):
        if "letters" not in held:
            held["letters"] = letter_table()
        size = max(1, 4_000_000 // max(1, len(model.languages)))
        found, start, chars = [], 0, 0
        for i, t in enumerate([*texts, None]):  # fewer letters at once when there are many languages
            if t is None or i > start and chars + len(t) > size:
                found += mixtures(texts[start:i], model, held["letters"])
                start, chars = i, 0
            chars += len(t or "")
        if min_score is not None:
            return [[f[0] != UNKNOWN and f[1] >= min_score for f in found]]
        return [list(x) for x in zip(*found, strict=True)] if found else [[], [], []]

    return map_texts(docs, text, carry, FIELDS if min_score is None else [], work, keep=min_score is not None)


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: key, ``extra`` columns, ``lang_pred``, ``score``, ``languages``. Reads nothing but the text."""
    return _mapped(docs, model, {key: key, **(extra or {})}, text, None)


def keep_identified(docs: DataFrame, model: Model, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """The documents with a known language whose share is ``min_score`` or more, with all their columns."""
    return _mapped(docs, model, {c: c for c in docs.columns}, text, min_score)
