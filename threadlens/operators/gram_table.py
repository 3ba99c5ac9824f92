"""Texts in packed slices: counts of tokens and neighbouring pairs, and the joining of pairs.

Most pairs of a corpus occur once or twice, so rows of pairs are several times as large as the texts. Here a slice, some
thousand texts of bounded size, is one compressed row that holds its words once and its tokens as numbers of words.

* A slice is counted by numbers. What it found is sorted by text and dealt to buckets, and the part that goes to a bucket is
  one compressed row. A bucket is added up alone: its keys are whole, so it knows how many there are, and only tokens and
  pairs that are frequent enough leave it. Buckets grow in number with the tokens.
* Phrases may be a table of any size. A table of bits tells nearly all pairs of a slice that are none, the others are joined
  to the phrases, and a slice meets its own phrases to join them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.runtime import one_row

# Bytes of a slice (a token has TOKEN_BYTES besides its text; one longer text is a slice alone), tokens to a
# bucket, and most bits of the table that tells pairs from phrases (8 MB).
SLICE_BYTES, TOKEN_BYTES = 12_000_000, 16
BUCKET_TOKENS = 500_000
MOST_BITS = 1 << 26

#: Hashes add up these weights of a text's bytes, so that the hash of a pair follows from those of its words.
WEIGHTS = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)
#: Odd numbers that mix the hashes of two words into a place among the bits.
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]

SLICE = "slice long, tokens long, packed binary"
BUCKET = "bucket int, size long, packed binary"
COUNTED = "a string, b string, n long"
PAIR = "slice long, pair long, a string, b string"


# --- slices ------------------------------------------------------------------


class Words:
    """The token column of a slice: ``words`` once each, ``codes`` of the tokens (-1: null), ``ends`` of the texts."""

    def __init__(self, lists: pa.Array):
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        self.absent = pc.is_null(lists)
        tokens = lists.flatten()
        tokens = tokens if isinstance(tokens, pa.DictionaryArray) else tokens.cast(pa.string()).dictionary_encode()
        self.words = tokens.dictionary
        self.codes = pc.fill_null(tokens.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def lists(self) -> pa.Array:
        """The column again, with the words that occur, once each, in their order."""
        once = self.words.dictionary_encode()
        codes = np.append(once.indices.to_numpy().astype(np.int64), -1)[self.codes]
        used = np.bincount(codes[codes >= 0], minlength=len(once.dictionary)) > 0
        words = once.dictionary.filter(pa.array(used))
        order = pc.sort_indices(words).to_numpy()  # neighbours in a packed row share their beginnings
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        number = np.full(len(used) + 1, -1)
        number[:-1][used] = rank
        codes = number[codes].astype(np.int32)
        tokens = pa.DictionaryArray.from_arrays(pa.array(codes, mask=codes < 0), words.take(pa.array(order)))
        return pa.ListArray.from_arrays(pa.array(self.ends.astype(np.int32)), tokens, mask=self.absent)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of tokens with a next one in their text, and the codes of both; nothing is joined over a null."""
        joins = np.ones(len(self.codes), bool)
        joins[self.ends[1:][np.diff(self.ends) > 0] - 1] = False
        there = self.codes >= 0
        at = np.flatnonzero(joins[:-1] & there[:-1] & there[1:])
        return at, self.codes[at], self.codes[at + 1]


def _place(schema: pa.Schema) -> int:
    return schema.get_field_index("tokens")


def _row(rows: pa.RecordBatch | pa.Table, held: Words, number: int) -> pa.RecordBatch:
    rows = rows.set_column(_place(rows.schema), "tokens", held.lists())
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.array([len(held.codes)], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["slice", "tokens", "packed"]
    )


def _open(packed: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(packed.as_buffer()).read_all().combine_chunks()


def _column(rows: pa.Table) -> Words:
    lists = rows["tokens"]
    return Words(lists.chunk(0) if lists.num_chunks == 1 else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type))


def _packed(batches) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    held, size = [], 0
    for batch in batches:
        lists = batch.column(_place(batch.schema))
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        tokens = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(lists.flatten()), 0).to_numpy(zero_copy_only=False).astype(np.int64) + TOKEN_BYTES)])
        ends = tokens[np.cumsum(lengths)] + TOKEN_BYTES * np.arange(1, len(lists) + 1)
        at = 0
        while at < len(lists):
            start = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, start + SLICE_BYTES - size, side="right"))
            to = max(to, at if held else at + 1)
            if to > at:
                held.append(batch.slice(at, to - at))
                size, at = size + int(ends[to - 1] - start), to
            if at < len(lists):  # the next text does not fit
                rows = pa.Table.from_batches(held)
                yield _row(rows.combine_chunks(), _column(rows), number)
                held, size, number = [], 0, number + 1
    if held:
        rows = pa.Table.from_batches(held)
        yield _row(rows.combine_chunks(), _column(rows), number)


def pack(texts: DataFrame) -> DataFrame:
    """Slices of rows with ``tokens``: (slice, tokens, packed). Write it once: numbers follow how rows are dealt to tasks."""
    place = texts.columns.index("tokens")
    columns = [F.col("tokens").cast("array<string>").alias("tokens") if i == place else F.col(f"`{c}`") for i, c in enumerate(texts.columns)]
    return texts.select(*columns).mapInArrow(_packed, SLICE)


def unpack(slices: DataFrame, schema) -> DataFrame:
    """The rows of the slices again."""

    def rows(batches):
        for batch in batches:
            for packed in batch.column(batch.schema.get_field_index("packed")):
                table = _open(packed)
                held = _column(table)
                tokens = pa.DictionaryArray.from_arrays(pa.array(held.codes.astype(np.int32), mask=held.codes < 0), held.words)
                lists = pa.ListArray.from_arrays(pa.array(held.ends.astype(np.int32)), tokens.dictionary_decode(), mask=held.absent)
                yield from table.set_column(_place(table.schema), "tokens", lists).to_batches(max_chunksize=1000)

    return slices.select("packed").mapInArrow(rows, schema)


# --- counts ------------------------------------------------------------------


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _hashes(words: pa.Array, ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every string, and the sum of their weights, which depend on the place in it if ``ordered``."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4)
    inside = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data else np.zeros(0, np.uint8)
    ends = offsets - offsets[0]
    weights = WEIGHTS[inside]
    if ordered:
        place = np.arange(len(inside)) - np.repeat(ends[:-1], np.diff(ends))
        weights = (weights ^ (weights >> np.uint64(31))) * (2 * place + 1).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(weights, dtype=np.uint64)])
    return np.diff(ends), sums[ends[1:]] - sums[ends[:-1]]


def _small(values: np.ndarray) -> np.ndarray:
    return values.astype(np.min_scalar_type(values.max(initial=0)))


def _pack(lengths: np.ndarray, splits: np.ndarray, counts: np.ndarray, text: memoryview) -> tuple[int, bytes]:
    columns = [_small(x) for x in (lengths, splits, counts)]
    head = np.array([len(lengths), *(x.itemsize for x in columns)], np.int64)
    plain = b"".join([head.tobytes(), *(x.tobytes() for x in columns), text])
    return len(plain), _codec().compress(plain, asbytes=True)


def _unpack(size: int, packed: pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]:
    plain = memoryview(_codec().decompress(packed, decompressed_size=size))
    rows, *widths = np.frombuffer(plain, np.int64, 4).tolist()
    columns, at = [], 32
    for width in widths:
        columns.append(np.frombuffer(plain, f"u{width}", rows, at).astype(np.int64))
        at += rows * width
    return *columns, plain[at:]


def _count(held: Words, buckets: int) -> pa.RecordBatch:
    """One row a bucket: keys, bytes before the joint plus one (0: a single token) and counts of a slice."""
    words = held.words
    singles = np.bincount(held.codes[held.codes >= 0], minlength=len(words))
    single = np.flatnonzero(singles)
    _, first, second = held.pairs()
    pairs, n = np.unique(first * len(words) + second, return_counts=True)
    a, b = np.divmod(pairs, max(1, len(words)))
    lengths, sums = _hashes(words)

    hashes = np.concatenate([sums[single], sums[a] + sums[b] + WEIGHTS[ord("_")]])
    dealt = ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(dealt, kind="stable")
    keys = pa.concat_arrays([words.take(pa.array(single)), pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), "_")])
    keys = keys.take(pa.array(order))
    splits = np.concatenate([np.zeros(len(single), np.int64), lengths[a] + 1])[order]
    counts = np.concatenate([singles[single], n])[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(dealt, minlength=buckets))])
    _, offsets, data = keys.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(keys) + 1, keys.offset * 4)
    text = memoryview(data) if data else memoryview(b"")
    rows = []
    for bucket in np.flatnonzero(np.diff(bounds)).tolist():
        i, j = bounds[bucket], bounds[bucket + 1]
        rows.append((bucket, *_pack(np.diff(offsets[i : j + 1]), splits[i:j], counts[i:j], text[offsets[i] : offsets[j]])))
    kinds = (pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else ([], [], []), kinds, strict=True)], names=["bucket", "size", "packed"])


def _between(text: pa.Buffer, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings at the given places of a text; places are in order and do not overlap."""
    bounds = np.append(np.stack([starts, ends], axis=1).ravel(), ends[-1:] if len(ends) else [0]).astype(np.int64)
    spaced = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), text)
    return spaced.take(pa.array(np.arange(len(starts)) * 2)).cast(pa.string())


def _add_up(rows: pa.Table, above: int | None) -> pa.Table:
    """Of a bucket: how many keys (``a`` null), its single tokens (``b`` null), its pairs whose key counts over ``above``.

    Counts are of the joined text, so that two splits of one text, and a token that looks like a pair, add up.
    """
    columns = [rows[c].combine_chunks() for c in ("size", "packed")]
    parts = [_unpack(size, packed.as_buffer()) for size, packed in zip(columns[0].to_pylist(), columns[1], strict=True)]
    lengths, splits, counts = (np.concatenate([x[i] for x in parts]) for i in range(3))
    text = pa.py_buffer(b"".join(x[3] for x in parts))
    del parts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    found = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), text).dictionary_encode()
    codes = found.indices.to_numpy()
    total = np.zeros(len(found.dictionary), np.int64)
    np.add.at(total, codes, counts)
    single = np.unique(codes[splits == 0])
    kept = np.flatnonzero((splits > 0) if above is None else (splits > 0) & (total[codes] > above))
    _, first = np.unique(codes[kept] * (splits.max(initial=0) + 1) + splits[kept], return_index=True)
    kept = np.sort(kept[first])
    joint = offsets[kept] + splits[kept]
    a, b = _between(text, offsets[kept], joint - 1), _between(text, joint, offsets[kept + 1])
    words = found.dictionary.take(pa.array(single)).cast(pa.string())
    return pa.table(
        {
            "a": pa.concat_arrays([pa.nulls(1, pa.string()), words, a]),
            "b": pa.concat_arrays([pa.nulls(1 + len(words), pa.string()), b]),
            "n": pa.array(np.concatenate([[len(total)], total[single], total[codes[kept]]]).astype(np.int64)),
        }
    )


def gram_table(slices: DataFrame, above: int | None = None) -> DataFrame:
    """(a, b, n): the count of every token's text (``b`` null) and of every pair whose text counts more than ``above``.

    n counts a text wherever it comes from, a token or any pair that joins to it. Rows with ``a`` null
    hold in n how many texts there are, a part each: their sum is the number of distinct texts.
    """
    buckets = 1 + (one_row(slices, n=F.sum("tokens"))["n"] or 0) // BUCKET_TOKENS

    def count(batches):
        for batch in batches:
            for packed in batch.column(0):
                yield _count(_column(_open(packed)), buckets)

    return slices.select("packed").mapInArrow(count, BUCKET).groupBy("bucket").applyInArrow(lambda rows: _add_up(rows, above), COUNTED)


# --- joining -----------------------------------------------------------------


def _bits(a: np.ndarray, b: np.ndarray, size: int) -> list[np.ndarray]:
    """Two places of a pair among ``size`` bits, a power of two, from the hashes of its words."""
    mixed = a * MIX[0] + b * MIX[1]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX[2]
    return [((x >> np.uint64(24)) & np.uint64(size - 1)).astype(np.int64) for x in (mixed, (mixed ^ (mixed >> np.uint64(29))) * MIX[1])]


def _table_of_bits(phrases: DataFrame) -> np.ndarray:
    """Bits at the places of the phrases: one in 8 or fewer, or more where that takes over MOST_BITS."""
    size = min(MOST_BITS, 1 << max(10, (16 * phrases.count()).bit_length()))

    def places(batches):
        for batch in batches:
            a, b = (_hashes(batch.column(i).cast(pa.string()), ordered=True)[1] for i in range(2))
            at = np.unique(np.concatenate(_bits(a, b, size)))
            word, first = np.unique(at >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int32)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    found = phrases.select("a", "b").where("a is not null and b is not null").mapInArrow(places, "word int, bits long")
    found = found.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _join(rows: pa.Table, phrases: pa.Table) -> pa.Table:
    """A slice with its phrases joined from left to right: in a run of matches, every other one is taken."""
    table = _open(rows["packed"].combine_chunks()[0])
    held = _column(table)
    known = np.sort(phrases["pair"].to_numpy())
    at, a, b = held.pairs()
    number = np.searchsorted(known, a * len(held.words) + b)
    hits = np.flatnonzero(number < len(known))
    hits = hits[known[number[hits]] == (a * len(held.words) + b)[hits]]
    at, number = at[hits], number[hits]
    opens = np.append(True, np.diff(at) > 1)[: len(at)]
    start = at[opens][np.cumsum(opens) - 1] if len(at) else at
    taken = (at - start) % 2 == 0
    at, number = at[taken], number[taken]

    first, second = np.divmod(known, max(1, len(held.words)))
    joined = pc.binary_join_element_wise(held.words.take(pa.array(first)), held.words.take(pa.array(second)), "_")
    held.codes[at] = len(held.words) + number
    held.words = pa.concat_arrays([held.words, joined])
    stay = np.ones(len(held.codes), bool)
    stay[at + 1] = False
    held.codes, held.ends = held.codes[stay], np.concatenate([[0], np.cumsum(stay)])[held.ends]
    return pa.Table.from_batches([_row(table, held, rows["slice"][0].as_py())])


def phrases_of_slices(slices: DataFrame, phrases: DataFrame) -> DataFrame:
    """(slice, pair): the numbers that accepted pairs (a, b) have in the slices they occur in.

    ``phrases`` is read twice: it should be a written table.
    """
    sent = slices.sparkSession.sparkContext.broadcast(_table_of_bits(phrases))

    def near(batches):
        table = sent.value
        for batch in batches:
            for number, packed in zip(batch.column(0), batch.column(1), strict=True):
                held = _column(_open(packed))
                _, sums = _hashes(held.words, ordered=True)
                _, a, b = held.pairs()
                may = np.ones(len(a), bool)
                for bits in _bits(sums[a], sums[b], len(table) << 6):
                    may &= (table[bits >> 6] >> (bits & 63).astype(np.uint64)) & np.uint64(1) > 0
                pairs = np.unique(a[may] * len(held.words) + b[may])
                words = [held.words.take(pa.array(x)) for x in np.divmod(pairs, max(1, len(held.words)))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), number.as_py())), pa.array(pairs), *words], names=["slice", "pair", "a", "b"])

    found = slices.select("slice", "packed").mapInArrow(near, PAIR)
    return found.join(phrases.select("a", "b"), ["a", "b"], "left_semi").select("slice", "pair")


def join_pairs(slices: DataFrame, pairs: DataFrame) -> DataFrame:
    """The slices with their ``pairs``, of ``phrases_of_slices``, joined by ``_``, from left to right and without overlap."""
    return slices.groupBy("slice").cogroup(pairs.groupBy("slice")).applyInArrow(_join, SLICE)
