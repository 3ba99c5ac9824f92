"""Maximal periodic runs of words: Lyndon arrays by Baier grouping, roots extended through LCE.

A run is a stretch of words with smallest period q and at least max(``least``, 2q) words that no neighbouring word
extends. Every run holds a root that is the longest Lyndon word at its place under the plain or the reversed
order of words. So the first phase of Baier's suffix sorter is run under both orders: it refines groups of
suffixes until each group's context is the longest Lyndon prefix of its members, whose length is the Lyndon
array directly. Each (place, length) is then extended both ways by longest common extensions, which come
from ranks of blocks of 1, 2, 4, ... words. All stretches of a slice of documents are worked on together, parted by
a word that is smaller than any other under both orders.

Only words in a stretch of repeated ``GRAM``-grams are sorted, which loses nothing: in a run of 12 words or more,
the words that recur one period on are at least 6, and at least as many as the period. So grams that recur in
the document cover the whole run.

The work is one map; a task holds one slice of texts (a longer text alone).

Defined results: null, empty and blank texts have no words and no runs; repeated rows are rows of their own; null keys
pass through; runs are ordered by start, then period. Extra columns are not read, so they may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlens.llm.common import map_texts

#: Words of a run, at least.
LEAST = 12
RUN_FIELDS = ("start", "length", "period")
RUNS = pa.struct([(name, pa.int64()) for name in RUN_FIELDS])


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every place; symbols are 1 and more, 0 parts the stretches and comes first.

    Groups go from highest to lowest. A member's nearest place to the left in a lower group is extended by the
    member's context, once for every member that points to it.
    """
    ranked = np.unique(symbols, return_inverse=True)[1]
    order = np.argsort(ranked, kind="stable")
    members = [part.tolist() for part in np.split(order, np.cumsum(np.bincount(ranked))[:-1])]
    group = ranked.tolist()
    length = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    left = list(range(len(group)))  # itself while its group is lower than the one at work
    at = len(members) - 1
    while at > 0:
        here = [i for i in members[at] if group[i] == at]
        members[at] = None
        for i in here:
            left[i] = i - 1
        pointers: dict[int, int] = {}
        for i in here:
            j = i - 1
            while left[j] != j:
                left[j] = left[left[j]]
                j = left[j]
            left[i] = j
            pointers[j] = pointers.get(j, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for j, times in pointers.items():
            if group[j]:
                moved.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(moved, reverse=True):
            new = len(members)
            members.append(moved[times, old])
            length.append(length[old] + times * length[at])
            below.append(old)
            above.append(above[old])
            below[above[old]] = new
            above[old] = new
            for j in members[new]:
                group[j] = new
        at = below[at]
    return np.array(length)[group]


class Extensions:
    """Longest common extensions by ranks of blocks of 1, 2, 4, ... symbols; ``longest`` bounds what is asked."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.size = len(symbols)
        self.ranks = [symbols.astype(np.int32)]
        while 2 ** len(self.ranks) <= min(longest, self.size):
            last, step = self.ranks[-1], 2 ** (len(self.ranks) - 1)
            both = last[:-step].astype(np.int64) * (int(last.max()) + 1) + last[step:]
            self.ranks.append(np.unique(both, return_inverse=True)[1].astype(np.int32))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols from i on that equal those from j on (i < j)."""
        found = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            ranks = self.ranks[level]
            fits = np.flatnonzero(j + found < len(ranks))
            same = fits[ranks[i[fits] + found[fits]] == ranks[j[fits] + found[fits]]]
            found[same] += 2**level
        return found

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols before i that equal those before j (i < j)."""
        found = np.zeros(len(i), dtype=np.int64)
        for level in reversed(range(len(self.ranks))):
            ranks, step = self.ranks[level], 2**level
            fits = np.flatnonzero(i - found >= step)
            same = fits[ranks[i[fits] - found[fits] - step] == ranks[j[fits] - found[fits] - step]]
            found[same] += step
        return found


def symbol_runs(symbols: np.ndarray, longest: int, least: int = LEAST) -> np.ndarray:
    """(start, length, period) rows of all runs; ``symbols`` begins with 0, and 0 parts the stretches."""
    reverse = np.where(symbols > 0, int(symbols.max()) + 1 - symbols, 0)
    places = np.flatnonzero(symbols)
    roots = np.concatenate([np.stack([places, lyndon_lengths(order)[places]], axis=1) for order in (symbols, reverse)])
    place, period = np.unique(roots, axis=0).T
    lce = Extensions(symbols, longest)
    right, left = lce.ahead(place, place + period), lce.back(place, place + period)
    length = left + period + right
    found = np.flatnonzero(length >= np.maximum(least, 2 * period))
    rows = np.stack([(place - left)[found], length[found], period[found]], axis=1)
    return np.unique(rows, axis=0)


def _covered(ids: np.ndarray, document: np.ndarray, gram: int) -> np.ndarray:
    """Words inside a gram that occurs twice or more in its document (equal hashes count: too much does no harm)."""
    many = len(ids) - gram + 1
    covered = np.zeros(len(ids) + 1, dtype=np.int64)
    if many <= 0:
        return covered[:-1].astype(bool)
    mix = np.random.default_rng(11).integers(1, 2**63, gram + 1, dtype=np.uint64) | np.uint64(1)
    value = document[:many].astype(np.uint64) * mix[gram]
    for k in range(gram):
        value ^= (ids[k : k + many].astype(np.uint64) + np.uint64(k + 1)) * mix[k] + (value >> np.uint64(29))
    inside = np.flatnonzero(document[:many] == document[gram - 1 :])
    order = inside[np.argsort(value[inside], kind="stable")]
    equal = value[order[1:]] == value[order[:-1]]
    again = np.concatenate([order[1:][equal], order[:-1][equal]])
    np.add.at(covered, again, 1)
    np.add.at(covered, again + gram, -1)
    return np.cumsum(covered)[:-1] > 0


def word_runs(texts: list[list], least: int = LEAST) -> list[np.ndarray]:
    """(start, length, period) rows by start, then period, for every list of words."""
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    found = [np.zeros((0, 3), dtype=np.int64)] * len(texts)
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known) + 1) for words in texts for w in words), dtype=np.int64, count=int(sizes.sum()))
    del known
    document, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    inside = _covered(ids, document, max(1, least // 2))
    # stretches of covered words in one document, long enough for a run
    edge = np.flatnonzero(np.concatenate([[True], (inside[1:] != inside[:-1]) | (document[1:] != document[:-1]), [True]])) if len(ids) else np.zeros(1, dtype=np.int64)
    start, length = edge[:-1], np.diff(edge)
    keep = inside[start] & (length >= least) if len(start) else np.zeros(0, dtype=bool)
    start, length = start[keep], length[keep]
    if not len(start):
        return found
    offset = np.cumsum(length + 1) - length  # a parting zero before every stretch
    symbols = np.zeros(int((length + 1).sum()), dtype=np.int64)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    symbols[np.repeat(offset, length) + within] = ids[np.repeat(start, length) + within]
    rows = symbol_runs(symbols, int(length.max()), least)
    stretch = np.searchsorted(offset, rows[:, 0], side="right") - 1
    word = rows[:, 0] - offset[stretch] + start[stretch]
    owner = document[word]
    rows[:, 0] = word - first[owner]
    order = np.lexsort((rows[:, 2], rows[:, 0], owner))
    rows, owner = rows[order], owner[order]
    for d in np.unique(owner):
        found[d] = rows[np.searchsorted(owner, d) : np.searchsorted(owner, d, side="right")]
    return found


def collapse(words: list, runs: np.ndarray) -> list:
    """The words that no run holds after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, rewrite=None) -> DataFrame:
    """One row per document: key, ``n_words``, ``runs`` (start, length, period) and ``collapsed``, the kept words joined by spaces.

    ``rewrite(words, key)`` may change a document's words (bytes) before runs are sought.
    """

    def work(texts, batch):
        words = [t.encode().split() for t in texts]
        if rewrite:
            words = [rewrite(w, k) for w, k in zip(words, batch.column(0).to_pylist(), strict=True)]
        runs = word_runs(words, least)
        rows = np.concatenate(runs) if runs else np.zeros((0, 3), dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(rows[:, c]) for c in range(3)], fields=list(RUNS))
        kept = [b" ".join(collapse(w, r)).decode() for w, r in zip(words, runs, strict=True)]
        return [[len(w) for w in words], pa.ListArray.from_arrays(pa.array(ends), fields), kept]

    spark_type = f"array<struct<{','.join(f'{n}:bigint' for n in RUN_FIELDS)}>>"
    return map_texts(docs, text, {key: key}, [("n_words", "long", pa.int64()), ("runs", spark_type, pa.list_(RUNS)), ("collapsed", "string", pa.string())], work)
