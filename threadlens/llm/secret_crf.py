"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The CRF tags tokens (runs of letters, digits and ``_+/-``) as begin, inside or outside of a secret. Its
features are the token's shape, its own word, the words before and after it, the marks around it and the
file's size and digit share. It is trained here by maximum conditional likelihood (forward-backward, Adagrad) on
windows of a bounded sample of documents. Labels are the patterns' spans, and generated secrets of other forms
(``secret_forms``) put into copies of windows, beside generated strings that only resemble secrets. Windows where
something with a digit follows a word of keys without being a pattern's span are left out, as nobody knows what
it is. Decoding is Viterbi. A token whose "outside" score leads by more than two transitions can change is outside
on every best path, so the chain is cut there and Viterbi runs on what lies between; the result is the same as
over the whole chain. Features of a text longer than ``PIECE`` characters are made piece by piece, with the words
at the seams carried over, so they are those of the whole text.

Pattern spans always stay; a CRF span is added when it has ``MIN_SECRET`` characters and overlaps none; it
holds no white space, as no secret that the model was shown does. The word feature reads the first 64
characters of a token; size and classes read all.
Defined results: null text counts as empty (no spans); an untrained model (no rows) adds nothing; spans are in
code points, end exclusive, over whole texts. Input columns that carry a result's name are replaced.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import map_texts, parts
from threadlens.llm.secret_forms import harmless, secret

#: The base patterns. Letters are listed in both cases, as folding would admit other letters.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
#: One of these is in the lower-cased text whenever ASSIGN matches.
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

#: Bounds of the training sample: documents, windows of one document, tokens of a window.
SAMPLE_DOCS, WINDOWS_PER_DOC, WINDOW = 4000, 8, 16
#: Characters on each side of a generated string in its copied window; characters whose features are made at once.
BESIDE, PIECE = 160, 1_000_000
EPOCHS, RATE, PENALTY, TINY = 60, 0.3, 1e-5, 1e-300
MIN_SECRET = 8
MARK = "[SECRET]"

OUTSIDE, BEGIN, INSIDE = 0, 1, 2
HASHES = 1 << 14
#: Something with a digit after a word of keys: not known to be harmless.
UNSURE = re.compile(r"(?i)(?:pass|pwd|secret|token|key|auth|bearer|credential|login)\w{0,12}\W{1,4}(?:is\s)?[^\s\d]{0,24}\d\S{6,}")
SPACE = re.compile("[\t-\r\x1c-\x20\x85\xa0]")
#: Number of values of each feature, in order.
SIZES = (32, 16, 24, HASHES, HASHES, HASHES, 64, 2, 16)
OFFSETS = np.cumsum((0, *SIZES))
#: Columns of the word features, and the feature (always of weight 0) that stands for an unread word.
WORDS, UNREAD = (3, 4, 5), int(OFFSETS[-1])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed."""
    found = []
    lowered = text.lower()
    if any(h in lowered for h in HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 0x250: bits of the class (1 lower, 2 upper, 4 digit, 8 mark of a token); kind of separator."""
    kinds, marks = np.zeros(0x251, dtype=np.uint8), np.full(0x251, 7, dtype=np.uint8)
    for point in range(0x250):
        c = chr(point)
        if c.isalpha():
            kinds[point] = 2 if c.isupper() else 1
        elif c.isdecimal():
            kinds[point] = 4
        elif c in "_+/-":
            kinds[point] = 8
        if c.isspace():
            marks[point] = 0
        elif c in "=:\"'.,":
            marks[point] = "=:\"'.,".index(c) + 1 if c != "'" else 3
    kinds[0x250] = 1
    return kinds, marks


CHAR_KINDS, CHAR_MARKS = _char_tables()
POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def _file_features(texts: list[str]) -> np.ndarray:
    """Size and digit share of whole texts, in steps."""
    lengths = np.array([len(t) for t in texts])
    share = np.array([sum(map(t.count, "0123456789")) for t in texts]) / np.maximum(lengths, 1)
    return np.searchsorted([0.002, 0.01, 0.05], share) * 4 + np.searchsorted([199, 1999, 19999], lengths)


def featurize(texts: list[str], file: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers (tokens x features), and text, start and end of every token.

    ``file`` gives the features of the files where ``texts`` are parts of them.
    """
    file = _file_features(texts) if file is None else file
    joined = "\n".join(["", *texts, ""])
    points = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0x250).astype(np.uint16)
    kinds, marks = CHAR_KINDS[points], CHAR_MARKS[points]
    token = kinds > 0
    edge = np.flatnonzero(token[1:] != token[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros((0, len(SIZES)), dtype=np.int64), *(np.zeros(0, dtype=np.int64),) * 3
    lengths = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(lengths) - lengths + 1
    owner = np.searchsorted(begins, start, side="right") - 1

    size = end - start
    classes = np.bitwise_or.reduceat(kinds, edge)[::2].astype(np.int64)

    def turns(kind: np.ndarray) -> np.ndarray:
        """Changes of ``kind`` inside each token."""
        sums = np.concatenate(([0, 0], np.cumsum((kind[1:] != kind[:-1]) & token[1:] & token[:-1], dtype=np.int32)))
        return sums[end] - sums[start + 1]

    switches = np.minimum(turns(kinds == 4), 5) + 6 * np.searchsorted([0.15, 0.35, 0.55], turns(kinds) / size)

    short = np.minimum(size, 64)
    first = np.cumsum(short) - short
    place = np.arange(int(short.sum())) - np.repeat(first, short)
    folded = points[np.repeat(start, short) + place].astype(np.uint64) | np.uint64(32)
    words = np.add.reduceat(folded * POWERS[place], first)
    words = ((words ^ (words >> np.uint64(29)) ^ (words >> np.uint64(47))) & np.uint64(HASHES - 1)).astype(np.int64)
    spaced = np.concatenate(([0], np.cumsum(marks == 0, dtype=np.int32)))
    joined_to = np.zeros(len(start), dtype=np.int64)
    joined_to[1:] = spaced[start[1:]] == spaced[end[:-1]]
    same = owner[1:] == owner[:-1]
    before, after = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
    before[1:][same], after[:-1][same] = words[:-1][same], words[1:][same]

    mixed = np.where(classes & 4 == 0, 0, np.where(classes & 3 == 0, 1, 2))
    shape = np.searchsorted([4, 8, 12, 16, 20, 32, 40], size) * 4 + mixed
    around = marks[start - 1].astype(np.int64) * 8 + marks[end]
    columns = (shape, classes, switches, words, before, after, around, joined_to, file[owner])
    return np.stack([c + o for c, o in zip(columns, OFFSETS, strict=False)], axis=1), owner, start - begins[owner], end - begins[owner]


def cuts(text: str) -> list[int]:
    """Places behind white space that cut a text into pieces of ``PIECE`` characters or more, with both ends."""
    out = [0]
    while len(text) - out[-1] > PIECE and (space := SPACE.search(text, out[-1] + PIECE)):
        out.append(space.end())
    return [*out, len(text)] if out[-1] < len(text) or len(out) == 1 else out


@dataclass
class Crf:
    """Weights by feature and label, and transitions between labels."""

    weights: np.ndarray
    moves: np.ndarray


def fit(features: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS) -> Crf:
    """Maximum conditional likelihood over windows (windows x WINDOW x features, windows x WINDOW).

    Every window is used twice, once without its words, so that shapes learn to decide alone as well.
    """
    unread = features.copy()
    unread[:, :, WORDS] = UNREAD
    features, labels = np.concatenate([features, unread]), np.concatenate([labels, labels])
    n_features, (n, length) = UNREAD + 1, labels.shape
    weights, moves = np.zeros((n_features, 3)), np.zeros((3, 3))
    weight_speed, move_speed = np.zeros_like(weights), np.zeros_like(moves)
    columns, target = [np.ascontiguousarray(features[:, :, k]) for k in range(len(SIZES))], np.eye(3)[labels]
    told = np.zeros((3, 3))
    np.add.at(told, (labels[:, :-1], labels[:, 1:]), 1)
    for _ in range(epochs):
        unary = weights[columns[0]]
        for column in columns[1:]:
            unary += weights[column]
        unary = np.exp(unary - unary.max(axis=2, keepdims=True))
        move = np.exp(moves)
        # forward and backward products, scaled to sum 1 at every step
        forward, backward = unary / unary.sum(axis=2, keepdims=True), np.full_like(unary, 1 / 3)
        for t in range(1, length):
            made = (forward[:, t - 1] @ move) * unary[:, t]
            forward[:, t] = made / np.maximum(made.sum(axis=1, keepdims=True), TINY)
            back = length - 1 - t
            made = (unary[:, back + 1] * backward[:, back + 1]) @ move.T
            backward[:, back] = made / np.maximum(made.sum(axis=1, keepdims=True), TINY)
        error = forward * backward
        error /= np.maximum(error.sum(axis=2, keepdims=True), TINY)
        error -= target
        left, right = forward[:, :-1], (unary * backward)[:, 1:]
        right /= np.maximum(((left @ move) * right).sum(axis=2, keepdims=True), TINY)
        pairs = (left.reshape(-1, 3).T @ right.reshape(-1, 3)) * move
        slope = PENALTY * weights
        for column in columns:
            slope += np.stack([np.bincount(column.ravel(), error[:, :, k].ravel(), n_features) for k in range(3)], axis=1) / n
        turn = (pairs - told) / n + PENALTY * moves
        weight_speed += slope**2
        move_speed += turn**2
        weights -= RATE * slope / np.sqrt(weight_speed + 1e-8)
        weights[UNREAD] = 0
        moves -= RATE * turn / np.sqrt(move_speed + 1e-8)
    return Crf(weights.astype(np.float32), moves.astype(np.float32))


def viterbi(unary: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best labels of one chain; ties to the smaller label."""
    score, back = unary[0], np.zeros(unary.shape, dtype=np.int8)
    for t in range(1, len(unary)):
        paths = score[:, None] + moves
        back[t] = paths.argmax(axis=0)
        score = paths.max(axis=0) + unary[t]
    labels = np.zeros(len(unary), dtype=np.int8)
    labels[-1] = score.argmax()
    for t in range(len(unary) - 1, 0, -1):
        labels[t - 1] = back[t, labels[t]]
    return labels


def decode(unary: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi labels of all tokens; chains (texts) are cut at tokens that are outside on every best path."""
    slack = 2 * float(moves.max() - moves.min())
    open_ = np.flatnonzero(unary[:, OUTSIDE] - unary[:, 1:].max(axis=1) <= slack)
    labels = np.zeros(len(unary), dtype=np.int8)
    if not len(open_):
        return labels
    cut = np.flatnonzero((np.diff(open_) != 1) | (np.diff(owner[open_]) != 0)) + 1
    for run in np.split(open_, cut):
        chain = unary[run].astype(np.float64)
        if run[0] > 0 and owner[run[0] - 1] == owner[run[0]]:
            chain[0] += moves[OUTSIDE]
        if run[-1] + 1 < len(owner) and owner[run[-1] + 1] == owner[run[-1]]:
            chain[-1] += moves[:, OUTSIDE]
        labels[run] = viterbi(chain, moves)
    return labels


def unaries(texts: list[str], model: Crf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the labels (tokens x labels), and text, start and end of every token; long texts piece by piece."""
    made = []

    def add(of: list[int], bodies: list[str], file: np.ndarray, offset: int) -> None:
        features, owner, start, end = featurize(bodies, file)
        if not len(features):
            return
        if offset and made and made[-1][1][-1] == of[0]:  # the words on both sides of the seam
            features[0, WORDS[1]] += made[-1][4] - OFFSETS[WORDS[0]]
            made[-1][0][-1] += model.weights[features[0, WORDS[0]] - OFFSETS[WORDS[0]] + OFFSETS[WORDS[2]]] - model.weights[OFFSETS[WORDS[2]]]
        unary = model.weights[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            unary += model.weights[features[:, k]]
        made.append((unary, np.array(of, dtype=np.int32)[owner], (start + offset).astype(np.int32), (end + offset).astype(np.int32), features[-1, WORDS[0]]))

    short = [i for i, text in enumerate(texts) if len(text) <= PIECE]
    add(short, [texts[i] for i in short], _file_features([texts[i] for i in short]), 0)
    for i, text in enumerate(texts):
        if len(text) > PIECE:
            places, file = cuts(text), _file_features([text])
            for a, b in zip(places, places[1:], strict=False):
                add([i], [text[a:b]], file, a)
    if not made:
        return np.zeros((0, 3), dtype=np.float32), *(np.zeros(0, dtype=np.int32),) * 3
    return tuple(np.concatenate([m[k] for m in made]) for k in range(4))


def crf_spans(texts: list[str], model: Crf) -> list[list[tuple[int, int]]]:
    """(start, end) of what the CRF tags, per text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    unary, owner, start, end = unaries(texts, model)
    labels = decode(unary, owner, model.moves)
    last = -2
    for i in np.flatnonzero(labels):
        spans = out[owner[i]]
        if labels[i] == INSIDE and last == i - 1 and spans and owner[i - 1] == owner[i] and not SPACE.search(texts[owner[i]], end[i - 1], start[i]):
            spans[-1] = (spans[-1][0], int(end[i]))
        else:  # begin, or an inside that follows an outside or white space
            spans.append((int(start[i]), int(end[i])))
        last = i
    return out


def find(texts: list[str], model: Crf | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text, by start, then kind as listed."""
    tagged = crf_spans(texts, model) if model is not None else [[] for _ in texts]
    found = []
    for text, more in zip(texts, tagged, strict=True):
        spans = base_spans(text)
        added = [(a, b, "crf") for a, b in more if b - a >= MIN_SECRET and not any(a < e and s < b for s, e, _ in spans)]
        found.append(sorted(spans + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else spans)
    return found


def _labels(text: str, start: np.ndarray, end: np.ndarray, more: list[tuple[int, int]] = ()) -> np.ndarray:
    """Labels of one text's tokens by the patterns and ``more`` spans; -1 where nobody knows."""
    labels = np.zeros(len(start), dtype=np.int64)
    for m in UNSURE.finditer(text):
        labels[(end > m.start()) & (start < m.end())] = -1
    spans = [(ASSIGN.match(text, a).start() if kind == "assign" else a, ASSIGN.match(text, a).start(2) if kind == "assign" else a, b) for a, b, kind in base_spans(text)]
    for whole, a, b in [*spans, *((a, a, b) for a, b in more)]:
        labels[(start >= whole) & (end <= a)] = OUTSIDE
        inside = np.flatnonzero((start < b) & (end > a))
        labels[inside] = INSIDE
        labels[inside[:1]] = BEGIN
    return labels


def _copied(text: str, random: np.random.Generator, good: bool) -> tuple[str, list[tuple[int, int]], int]:
    """A window of the text with a generated secret (or a harmless string) in it, the secret's span, and its place."""
    places = [m.end() for m in SPACE.finditer(text, int(random.integers(max(len(text), 1))))][:1] or [len(text)]
    left, right = text[max(0, places[0] - BESIDE) : places[0]], text[places[0] : places[0] + BESIDE]
    left = left if not left or left[-1].isspace() else left + " "
    before, body, after = secret(random) if good else ("", harmless(random), "")
    at = len(left) + len(before)
    tail = "" if after and not right else " "
    return left + before + body + after + tail + right, [(at, at + len(body))] if good else [], at


def _training_windows(texts: list[str]) -> tuple[list, list]:
    """Windows around secrets, tokens with digits and any tokens of the texts, and around generated strings, with labels."""
    inputs, answers = [], []

    def add(features: np.ndarray, labels: np.ndarray, centres) -> None:
        for c in centres:
            take = np.clip(np.arange(WINDOW) + c - WINDOW // 2, 0, len(labels) - 1)
            if (labels[take] >= 0).all():
                inputs.append(features[take].ravel().tolist())
                answers.append(labels[take].tolist())

    for text in texts:
        random, file = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass"))), _file_features([text])
        places = cuts(text)
        piece = int(random.integers(len(places) - 1))  # of a long text one piece, drawn by its content
        text = text[places[piece] : places[piece + 1]]
        features, _, start, end = featurize([text], file)
        if len(features):
            labels = _labels(text, start, end)
            digits = np.flatnonzero((labels == OUTSIDE) & ((features[:, 1] - OFFSETS[1]) & 4 > 0))
            few = WINDOWS_PER_DOC // 2 - 1
            add(features, labels, [*np.flatnonzero(labels == BEGIN)[:few], *random.permutation(digits)[:few], *random.integers(len(labels), size=2)])
        for good in (True, False):
            copy, spans, at = _copied(text, random, good)
            features, _, start, end = featurize([copy], file)
            labels = _labels(copy, start, end, spans)
            if not good:  # a harmless string is known, also after a word of keys
                labels[(labels < 0) & (end > at)] = OUTSIDE
            else:
                labels[(labels < 0) & (np.abs(start - at) < 40)] = OUTSIDE
            add(features, labels, np.flatnonzero(end > at)[:1])
    return inputs, answers


def train(docs: DataFrame, text: str = "text", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Crf | None:
    """Fit on windows of about ``sample_docs`` documents, half of them with a word that secrets often follow."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lowered = F.lower(body)
    likely = F.lit(False)
    for hint in (*HINTS, "akia"):
        likely = likely | lowered.contains(hint)
    rows = docs.select(body.alias("_text"), likely.alias("_likely"), F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), 34).alias("_draw"))
    sizes = {r["_likely"]: r["count"] for r in rows.groupBy("_likely").count().collect()}
    share = {k: min(1.0, sample_docs / 2 / max(sizes.get(k, 0), 1)) for k in (True, False)}
    # a deterministic draw by key
    drawn = rows.where(F.col("_draw") < F.when(F.col("_likely"), F.lit(int(share[True] * 2**30))).otherwise(F.lit(int(share[False] * 2**30))))

    def run(batches):
        for _, texts in parts(batches, "_text"):
            inputs, answers = _training_windows(texts)
            yield pa.RecordBatch.from_arrays([pa.array(inputs, pa.list_(pa.int32())), pa.array(answers, pa.list_(pa.int8()))], names=["x", "y"])

    # the limit, on windows of known size, only bounds tables whose keys repeat
    found = drawn.select("_text").mapInArrow(run, "x array<int>, y array<tinyint>").limit(WINDOWS_PER_DOC * sample_docs).toPandas()
    if not len(found):
        return None
    features, labels = (np.stack(found[c].to_numpy()).astype(np.int32) for c in ("x", "y"))
    order = np.lexsort(np.concatenate([features, labels], axis=1).T)  # rows come in any order
    return fit(features[order].reshape(len(order), WINDOW, len(SIZES)), labels[order].astype(np.int64))


FIELDS = [
    ("n_assign", "long", pa.int64()),
    ("n_access", "long", pa.int64()),
    ("n_hex", "long", pa.int64()),
    ("n_crf", "long", pa.int64()),
    ("base_sha256", "string", pa.string()),
    ("spans", "string", pa.string()),
]


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, model: Crf | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: key, counts by kind, the digest of the pattern spans, and all spans."""

    def work(texts, _):
        found = find(texts, model)
        counts = [[sum(s[2] == kind for s in spans) for spans in found] for kind in KINDS]
        digests = [hashlib.sha256(written([s for s in spans if s[2] != "crf"]).encode()).hexdigest() for spans in found]
        return [*counts, digests, [written(s) for s in found]]

    return map_texts(docs, text, {key: key}, FIELDS, work)


def redact(docs: DataFrame, model: Crf | None, text: str = "text", mark: str = MARK) -> DataFrame:
    """The documents with every span replaced by ``mark``; null texts stay null."""
    carry: dict[str, str | Column] = {c: c for c in docs.columns}
    place = [c.lower() for c in carry].index(text.lower())
    carry.pop(docs.columns[place])

    def work(texts, piece):
        out = []
        for body, spans in zip(texts, find(texts, model), strict=True):
            made, at = [], 0
            for start, end, _ in spans:
                if start >= at:
                    made += [body[at:start], mark]
                at = max(at, end)
            out.append("".join(made) + body[at:])
        missing = piece.column(piece.schema.get_field_index("_text")).is_null().to_pylist()
        return [[None if gone else t for t, gone in zip(out, missing, strict=True)]]

    return map_texts(docs, text, carry, [(docs.columns[place], "string", pa.string())], work).select(*docs.columns)
