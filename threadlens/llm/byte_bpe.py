"""Byte-level BPE: encoding by the tokenizers library over Arrow batches, decoding by the byte table.

A text is cut where a single space follows and precedes something else. Every match of the pre-tokenization
pattern ends there, so units (" word") encode alone as they do inside the text, and equal units of a
batch are encoded once. A text with other runs of white space at a space goes to the library whole.

Offsets come from bytes: the token table gives each id's bytes, their running sum is the token's byte range, and
a table from bytes to characters gives the characters it touches; tokens that split a character share it.
Decoding joins the bytes of the ids, so characters split between tokens come out whole.

Files are read on the driver and shipped (a vocabulary has a fixed size), so executors need no path.
Defined results: null text counts as empty (no ids); special tokens' strings are ordinary text; unknown ids
raise. Input columns that carry a result's name are replaced by the result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlens.llm.common import map_texts

#: Units kept in a task; beyond, the store is emptied and filled anew.
STORE = 150_000
#: Units that go to the library as one text.
TOGETHER = 500
#: White space beside a space, or at an end: then a unit could cut a match of the pattern.
RUNS = re.compile(r"\s | \s|^ | $")


@dataclass
class Vocabulary:
    """What the library needs (its JSON), and the bytes of every id."""

    library_json: str
    table: list[bytes]


def load_vocabulary(json_path: str, ranks_path: str) -> Vocabulary:
    """Read both files of one vocabulary; they have to agree."""
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    with open(json_path, encoding="utf-8") as file:
        text = file.read()
    names = Tokenizer.from_str(text).get_vocab(with_added_tokens=False)
    shown = {c: b for b, c in byte_letters().items()}
    own = {bytes(shown[c] for c in name): i for name, i in names.items() if all(c in shown for c in name)}
    if any(own.get(token) != rank for token, rank in ranks.items()):
        raise ValueError("the two files hold different vocabularies")
    return Vocabulary(text, table)


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        letters.setdefault(b, chr(0x100 + sum(x not in plain for x in range(b))))
    return letters


class Encoder:
    """Encodes texts to ids as little-endian unsigned 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.library_json)
        self.library.encode_special_tokens = True
        self.sizes = np.array([len(t) for t in vocabulary.table], dtype=np.int64)
        self.spaced: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _learn(self, store: dict[str, bytes], units: set[str], lead: str) -> None:
        """Have all ``units`` in the store, which is emptied first if it is full."""
        missing = list(units - store.keys())
        if len(store) + len(missing) > STORE:
            store.clear()
            missing = list(units)
        # units behind a space encode alone as they do in a text, so also in a text of units; what has white space at
        # an end, or stands at the start of a text, goes alone
        alone = [u for u in missing if not (lead and u) or u[0].isspace() or u[-1].isspace()]
        for start in range(0, len(alone), 10_000):
            some = alone[start : start + 10_000]
            made = self.library.encode_batch_fast([lead + u for u in some], add_special_tokens=False)
            store.update((u, np.array(e.ids, dtype="<u4").tobytes()) for u, e in zip(some, made, strict=True))
        rest = list(set(missing).difference(alone))
        for start in range(0, len(rest), TOGETHER):
            some = rest[start : start + TOGETHER]
            made = self.library.encode_batch_fast([lead + lead.join(some)], add_special_tokens=False)[0]
            ids = np.array(made.ids, dtype="<u4")
            ends = np.cumsum([len(lead) + len(u.encode()) for u in some])
            places = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")).tolist()
            packed = ids.tobytes()
            store.update((u, packed[a:b]) for u, a, b in zip(some, [0, *places], places))

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        units, whole = {}, []
        for i, text in enumerate(texts):
            if RUNS.search(text):
                whole.append(i)
            else:
                units[i] = text.split(" ")
        self._learn(self.bare, {u[0] for u in units.values()}, "")
        self._learn(self.spaced, set().union(*(u[1:] for u in units.values())), " ")
        for i, (first, *rest) in units.items():
            out[i] = self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))
        for i in whole:
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, dtype="<u4").tobytes()
        return out


def offsets(text: str, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of every id; a character split between ids belongs to each of them."""
    body = np.frombuffer(text.encode(), dtype=np.uint8)
    character = np.concatenate([np.cumsum((body & 0xC0) != 0x80) - 1, [len(text)]])
    end = np.cumsum(sizes[ids])
    start = end - sizes[ids]
    return character[start], np.where(end > start, character[np.maximum(end, 1) - 1] + 1, character[start])


def decode_bytes(ids: bytes | np.ndarray, table: list[bytes]) -> bytes:
    """The bytes of the ids (an array, or little-endian unsigned 32-bit integers)."""
    numbers = np.frombuffer(ids, dtype="<u4") if isinstance(ids, bytes) else ids
    return b"".join(map(table.__getitem__, numbers.tolist()))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, ``ids`` and the characters ``starts`` to ``ends`` of each id."""
    held: dict = {}
    sizes = np.array([len(t) for t in vocabulary.table], dtype=np.int64)

    def work(texts, _):
        if "encoder" not in held:
            held["encoder"] = Encoder(vocabulary)
        ids = [np.frombuffer(b, dtype="<u4") for b in held["encoder"].encode(texts)]
        places = [offsets(t, i, sizes) for t, i in zip(texts, ids, strict=True)]
        return [[i.astype(np.int32) for i in ids], [p[0].astype(np.int32) for p in places], [p[1].astype(np.int32) for p in places]]

    ints = pa.list_(pa.int32())
    return map_texts(docs, text, {key: key}, [("ids", "array<int>", ints), ("starts", "array<int>", ints), ("ends", "array<int>", ints)], work)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row: key and ``text``; bytes that are no UTF-8 (cut id lists) become replacement characters. Null ids: null."""
    table = vocabulary.table

    def run(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            texts = [None if x is None else b"".join(map(table.__getitem__, x)).decode("utf-8", "replace") for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = encoded.select(key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, number of ids, SHA-256 of the ids and of the bytes they decode to."""
    held: dict = {}

    def work(texts, _):
        if "encoder" not in held:
            held["encoder"] = Encoder(vocabulary)
        found = held["encoder"].encode(texts)
        back = [hashlib.sha256(decode_bytes(ids, vocabulary.table)).hexdigest() for ids in found]
        return [[len(ids) // 4 for ids in found], [hashlib.sha256(ids).hexdigest() for ids in found], back]

    fields = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return map_texts(docs, text, {key: key}, fields, work)
