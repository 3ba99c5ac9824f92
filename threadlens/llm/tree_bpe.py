"""BPE encoding by tree concatenation: halves of a text are encoded apart and joined exactly.

A text is halved until its leaves hold at most ``leaf`` characters, with no regard to words. A leaf is encoded by the
tokenizers library, equal units once: a word of the pattern always starts where white space follows something else, and
behind a single white space other than a space, so the stretches between such places encode by themselves as they
do in the leaf. Neighbours are joined by encoding a window around the join anew. The window starts at a token of
the left side and grows until both sides agree with it:

* on the left, the window's first token is the one the left side has there, or a word of the pattern starts there;
* on the right, at some place behind the join, window and right side both start a word, or both are inside one
  word and have the same token before that place.

Why that is exact. The pattern reads from left to right and looks at most one character ahead, so reading on from the
start of a word gives the same words, and reading on inside a run of letters, digits, signs or spaces gives the rest
of that run. (A contraction, of 3 bytes at most, is no run, and no window starts inside a word at an apostrophe.)
Inside a word, merges apply in the order of their ranks and only build on lower ranks, so a list of tokens is the
encoding of the word if and only if each two neighbours are the encoding of their own bytes. Neighbours inside
the window or a side are; those at the two seams occur as neighbours in a side.

Texts above ``part`` characters are dealt in parts to many tasks and joined in rounds, ``FAN`` neighbours at
a time, so no task encodes a very long text alone. The text itself is written once to the shared folder, with a number
for every row, so that a lost executor cannot number rows anew.

Defined results: null text counts as empty (no ids); repeated rows are rows of their own; the special token's string in
a text is the special token, as in the library; ids without a token are left out when decoding; null ids decode to null.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_texts
from threadlens.runtime import snapshot

#: Characters of a leaf, and of the parts in which a very long text is dealt to tasks.
LEAF_CHARS, PART_CHARS = 4_096, 65_536
#: Bytes on each side of a join in its first window, and bytes at a cut end that decide no word.
WINDOW, MARGIN = 64, 32
#: Longest contraction of the pattern, in bytes.
SHORT = 3
#: Parts joined by one task in one round.
FAN = 8
#: Marks the ids that start a word.
FIRST = np.uint32(1 << 31)
#: Units kept in a task (beyond, those not met of late are dropped), and the longest that is kept.
STORE, UNIT_CHARS = 300_000, 64
#: White space behind something else; something else behind a single white space that no word takes in. (Python's white
#: space is the library's and four control characters.)
CONTROLS = "\x1c\x1d\x1e\x1f"
CUT = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f])|(?<=\S[^\S\x1c-\x1f ])(?=\S)")

#: Anything but single spaces and line breaks between other characters, or the mark that ``units`` cuts at. (A pattern
#: that starts with one set of characters is sought much faster than alternatives.)
OTHER = re.compile(r"[\s\x00](?:(?<![ \n])|(?=\s|\Z)|(?<=\A[\s\x00]))")


def units(text: str) -> list[str]:
    """What ``CUT`` parts; plain texts without a look at every place."""
    if OTHER.search(text):
        return CUT.split(text)
    return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")


@dataclass
class Vocabulary:
    """The library's JSON and the bytes of every id (special tokens: their string)."""

    library_json: str
    table: list[bytes]


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others as letters from U+0100 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + n): b for n, b in enumerate(others)}


def load_vocabulary(json_path: str) -> Vocabulary:
    """Read a byte-level BPE file; refuse one for which joining would not be exact."""
    with open(json_path, encoding="utf-8") as file:
        text = file.read()
    parts = json.loads(text)
    model, before = parts["model"], parts["pre_tokenizer"] or {}
    plain = parts["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("byte_fallback"):
        raise ValueError("only byte-level BPE without prefix space, normalizer, dropout or whole-word matches can be joined")
    letters = byte_of_letter()
    made = dict.fromkeys(letters, -1)
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if max(made.get(left, rank), made.get(right, rank)) >= rank:
            raise ValueError(f"merge {rank} uses a token of no lower rank")
        made.setdefault(left + right, rank)
    table = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in parts["added_tokens"])]) + 1)
    for name, i in model["vocab"].items():
        table[i] = bytes(letters[c] for c in name)
    for token in parts["added_tokens"]:
        name = token["content"].encode()
        if len(name) >= MARGIN or any(name[:k] == name[-k:] for k in range(1, len(name))) or token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"added token {token['content']!r} could overlap itself or reach beyond a margin")
        table[token["id"]] = name
    return Vocabulary(text, table)


class Encoded:
    """A stretch of bytes, its ids, the byte each id starts at, and whether it starts a word of the pattern."""

    __slots__ = ("body", "first", "ids", "starts")

    def __init__(self, body: bytes, ids: np.ndarray, starts: np.ndarray, first: np.ndarray):
        self.body, self.ids, self.starts, self.first = body, ids, starts, first


class TreeEncoder:
    """Encodes texts by leaves and joins; all leaves, then all windows of a level, go to the library together."""

    def __init__(self, vocabulary: Vocabulary, leaf: int = LEAF_CHARS, window: int = WINDOW):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(vocabulary.library_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.sizes = np.array([len(t) for t in vocabulary.table], dtype=np.int64)
        self.leaf, self.window = max(1, leaf), max(1, window)
        self.store: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _marked(self, texts: list[str]) -> Iterable[np.ndarray]:
        """The library's ids; those that start a word carry the mark."""
        for start in range(0, len(texts), 256):
            for made in self.library.encode_batch(texts[start : start + 256], add_special_tokens=False):
                words = np.array(made.word_ids, dtype=np.uint32)
                ids = np.array(made.ids, dtype=np.uint32)
                ids[np.flatnonzero(np.diff(words, prepend=np.uint32(2**32 - 1)))] |= FIRST
                yield ids

    def _library(self, texts: list[str]) -> list[Encoded]:
        return [self.known(t.encode(), ids & ~FIRST, ids >= FIRST) for t, ids in zip(texts, self._marked(texts), strict=True)]

    def _learn(self, units: list[str]) -> None:
        """Have all ``units`` in the store. Those that end in no white space are put together, a line break before each that
        starts with none: then every unit is cut off again where it starts and ends."""
        alone, spaced, bare = [], [], []
        for u in units:
            if not u or u[-1].isspace():
                alone.append(u)
            elif u[0] == " " or u[0].isspace() and u[0] not in CONTROLS:
                spaced.append(u)
            else:
                bare.append(u)
        self.store.update((u, ids.tobytes()) for u, ids in zip(alone, self._marked(alone), strict=True))
        for some, lead in ((spaced, ""), (bare, "\n")):
            for at in range(0, len(some), 500):
                few = some[at : at + 500]
                ids = next(iter(self._marked(["x" + "".join([lead + u for u in few])])))
                ends = 1 + np.cumsum([len(lead) + (len(u) if u.isascii() else len(u.encode())) for u in few])
                places = np.searchsorted(np.cumsum(self.sizes[ids & ~FIRST]), [1, *ends], side="right").tolist()
                packed = ids.tobytes()
                # a line break before a unit is a token of its own
                self.store.update((u, packed[4 * (b + len(lead)) : 4 * e]) for u, b, e in zip(few, places, places[1:]))

    def _leaves(self, texts: list[str]) -> list[Encoded]:
        cut = [units(text) for text in texts]
        if len(self.store) > STORE // 2:
            self.store, self.older = {}, self.store
        missing = set().union(*cut) - self.store.keys()
        back = missing & self.older.keys()
        self.store.update((u, self.older[u]) for u in back)
        missing = list(missing - back)
        self._learn(missing)
        out = []
        for text, own in zip(texts, cut, strict=True):
            ids = np.frombuffer(b"".join(map(self.store.__getitem__, own)), dtype=np.uint32)
            out.append(self.known(text.encode(), ids & ~FIRST, ids >= FIRST))
        for unit in missing:
            if len(unit) > UNIT_CHARS:
                del self.store[unit]
        return out

    def known(self, body: bytes, ids: np.ndarray, first: np.ndarray) -> Encoded:
        sizes = self.sizes[ids]
        return Encoded(body, ids, np.cumsum(sizes) - sizes, first)

    def encode(self, texts: list[str]) -> list[Encoded]:
        leaves, owners = [], []
        for text in texts:
            count = 1
            while -(-len(text) // count) > self.leaf:
                count *= 2
            cuts = [len(text) * k // count for k in range(count + 1)]
            owners.append(range(len(leaves), len(leaves) + count))
            leaves += [text[a:b] for a, b in zip(cuts, cuts[1:])]
        made = self._leaves(leaves)
        return self.join([[made[i] for i in own] for own in owners])

    def join(self, rows: list[list[Encoded]]) -> list[Encoded]:
        """One stretch for every row of neighbours, level by level."""
        rows = [list(row) for row in rows]
        while any(len(row) > 1 for row in rows):
            pairs = [(r, k) for r, row in enumerate(rows) for k in range(0, len(row) - 1, 2)]
            joined = dict(zip(pairs, self._join_pairs([(rows[r][k], rows[r][k + 1]) for r, k in pairs]), strict=True))
            rows = [[joined.get((r, k), row[k]) for k in range(0, len(row), 2)] for r, row in enumerate(rows)]
        return [row[0] for row in rows]

    def _join_pairs(self, pairs: list[tuple[Encoded, Encoded]]) -> list[Encoded]:
        done: list = [None] * len(pairs)
        open_, reach = list(range(len(pairs))), self.window
        while open_:
            edges = [(_opening(pairs[i][0], reach), _closing(pairs[i][1], reach)) for i in open_]
            windows = self._library([(left.body[_at(left, a) :] + right.body[: _at(right, b)]).decode() for (a, b), (left, right) in zip(edges, (pairs[i] for i in open_), strict=True)])
            for i, (a, b), window in zip(open_, edges, windows, strict=True):
                done[i] = _agree(*pairs[i], a, b, window)
            open_, reach = [i for i in open_ if done[i] is None], reach * 2
        return done


def _at(side: Encoded, token: int) -> int:
    """First byte of a token; behind the last token: the end."""
    return int(side.starts[token]) if token < len(side.starts) else len(side.body)


def _whole(side: Encoded, token: int) -> bool:
    """Whether a token starts with the first byte of a character."""
    return token >= len(side.ids) or side.body[int(side.starts[token])] & 0xC0 != 0x80


def _word(side: Encoded, token: int) -> int:
    """First byte of the word that holds a token."""
    while token > 0 and not side.first[token]:
        block = np.flatnonzero(side.first[max(0, token - 64) : token])
        token = max(0, token - 64) + int(block[-1]) if len(block) else max(0, token - 64)
    return int(side.starts[token])


def _opening(left: Encoded, reach: int) -> int:
    """The left side's token at which a window starts, at least ``reach`` bytes and a margin before the join."""
    token = int(np.searchsorted(left.starts, len(left.body) - max(reach, MARGIN), side="right")) - 1
    while token > 0 and not left.first[token]:
        start = int(left.starts[token])
        if _whole(left, token) and left.body[start : start + 1] != b"'" and start - _word(left, token) > SHORT:
            break
        token -= 1
    return max(token, 0)


def _closing(right: Encoded, reach: int) -> int:
    """The right side's token before which a window ends."""
    token = int(np.searchsorted(right.starts, reach + MARGIN))
    while not _whole(right, token):
        token += 1
    return token


def _agree(left: Encoded, right: Encoded, a: int, b: int, window: Encoded) -> Encoded | None:
    """Both sides joined through the window, or None if it has to grow."""
    if a > 0 and not left.first[a] and not (len(window.ids) and window.ids[0] == left.ids[a]):
        return None
    start, ahead = _at(left, a), len(left.body) - _at(left, a)  # the join is ``ahead`` bytes into the window
    first = window.first.copy()
    if len(first):
        first[0] = a < len(left.ids) and left.first[a] or a == 0
    if b >= len(right.ids):
        took, onward = len(window.ids), len(right.ids)
    else:
        places, mine, theirs = np.intersect1d(window.starts - ahead, right.starts[:b], assume_unique=True, return_indices=True)
        certain = (places >= 0) & (places <= _at(right, b) - MARGIN)
        mine, theirs = mine[certain], theirs[certain]
        words = np.flatnonzero(first[mine] & right.first[theirs])
        if len(words):
            took, onward = int(mine[words[0]]), int(theirs[words[0]])
        else:
            took = onward = -1
            for m, t in zip(mine.tolist(), theirs.tolist(), strict=True):
                inside = m > 0 and t > 0 and not first[m] and not right.first[t]
                if inside and window.ids[m - 1] == right.ids[t - 1] and window.starts[m - 1] - ahead == right.starts[t - 1]:
                    place = int(right.starts[t])
                    if place - _word(right, t) > SHORT and place + ahead - _word(window, m) > SHORT:
                        took, onward = m, t
                        break
            if took < 0:
                return None
    shift = len(left.body)
    return Encoded(
        left.body + right.body,
        np.concatenate([left.ids[:a], window.ids[:took], right.ids[onward:]]),
        np.concatenate([left.starts[:a], window.starts[:took] + start, right.starts[onward:] + shift]),
        np.concatenate([left.first[:a], first[:took], right.first[onward:]]),
    )


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of the ids; bytes that are no UTF-8 become replacement characters, unknown ids are left out."""
    return b"".join(map(table.__getitem__, ids[ids < len(table)].tolist())).decode("utf-8", "replace")


def _encoder(held: dict, vocabulary: Vocabulary, leaf: int, window: int) -> TreeEncoder:
    if "encoder" not in held:
        held["encoder"] = TreeEncoder(vocabulary, leaf, window)
    return held["encoder"]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", key: str = "doc_id", leaf: int = LEAF_CHARS, part: int = PART_CHARS, window: int = WINDOW) -> DataFrame:
    """One row per document: key and ``ids``, little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("string").alias("_body"))
    size = F.coalesce(F.length("_body"), F.lit(0))
    held: dict = {}

    def work(texts, _):
        made = _encoder(held, vocabulary, leaf, window).encode(texts)
        return [[e.ids.astype("<u4").tobytes() for e in made]]

    short = map_texts(rows.where(size <= part), "_body", {key: key}, [("ids", "binary", pa.binary())], work)
    long = snapshot(rows.where(size > part).withColumn("_row", F.monotonically_increasing_id()), "long-texts")
    most = long.agg(F.max(F.length("_body"))).first()[0]
    if most is None:
        return short
    return short.unionByName(_encode_long(long, key, -(-most // part), part, vocabulary, leaf, window))


def _encode_long(long: DataFrame, key: str, parts: int, part: int, vocabulary: Vocabulary, leaf: int, window: int) -> DataFrame:
    """Parts are encoded by many tasks and joined in rounds; (row, place) names a part."""
    held: dict = {}

    def cut(batches):
        for batch in batches:
            for row, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = body.as_py()
                for place, at in enumerate(range(0, len(body), part)):
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([place], pa.int64()), pa.array([body[at : at + part]], pa.string())], names=["_row", "_place", "_body"])

    columns = "_row long, _place long, _body binary, ids binary, first binary"
    names = [c.split()[0] for c in columns.split(", ")]

    def stretch(row: int, place: int, made: Encoded) -> pa.RecordBatch:
        cells = [[row], [place], [made.body], [made.ids.astype("<u4").tobytes()], [np.packbits(made.first).tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=names)

    def leaves(batches):
        encoder = _encoder(held, vocabulary, leaf, window)
        for batch in batches:
            for row, place, body in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                yield stretch(row, place, encoder.encode([body])[0])

    def join(rows: pa.Table) -> pa.Table:
        encoder = _encoder(held, vocabulary, leaf, window)
        some = sorted(rows.to_pylist(), key=lambda r: r["_place"])
        sides = []
        for r in some:
            ids = np.frombuffer(r["ids"], dtype="<u4").astype(np.uint32)
            sides.append(encoder.known(r["_body"], ids, np.unpackbits(np.frombuffer(r["first"], dtype=np.uint8), count=len(ids)).astype(bool)))
        return pa.Table.from_batches([stretch(some[0]["_row"], some[0]["_place"] // FAN, encoder.join([sides])[0])])

    pieces = long.select("_row", "_body").mapInArrow(cut, "_row long, _place long, _body string")
    made = pieces.repartition("_row", "_place").mapInArrow(leaves, columns)
    while parts > 1:
        made = made.groupBy("_row", F.expr(f"_place div {FAN}").alias("_group")).applyInArrow(lambda _, rows: join(rows), columns)
        parts = -(-parts // FAN)
    return long.select("_row", key).join(made.select("_row", "ids"), "_row").select(key, "ids")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row: key and ``text``."""
    table = vocabulary.table

    def run(batches):
        for batch in batches:
            texts = [None if x is None else decode_ids(np.frombuffer(x, dtype="<u4"), table) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = encoded.select(key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def digests(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """One row per row: key, number of ids, SHA-256 of the ids and of the text they decode to."""
    table = vocabulary.table

    def run(batches):
        for batch in batches:
            lists = [x or b"" for x in batch.column(1).to_pylist()]
            back = [hashlib.sha256(decode_ids(np.frombuffer(x, dtype="<u4"), table).encode()).hexdigest() for x in lists]
            columns = [batch.column(0), pa.array([len(x) // 4 for x in lists], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in lists]), pa.array(back, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = encoded.select(key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
