"""Small helpers of this package: table reading, text slices of bounded size, word rules."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; what ``bytes.split()`` splits at.
SPACES = " \t\n\x0b\x0c\r"

#: Characters worked on at once inside a task (one longer text is taken alone).
SLICE_CHARS = 1_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; null keys count as empty text."""
    return (F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def parts(batches, column: str, limit: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches with the texts of ``column`` (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        # lengths in bytes come from Arrow, so only one slice of the texts is in Python at a time
        start, held = 0, 0
        sizes = pc.binary_length(texts).to_pylist()
        for i, size in enumerate([*sizes, None]):
            if i > start and (i == len(sizes) or held + (size or 0) > limit):
                piece = batch.slice(start, i - start)
                yield piece, [t or "" for t in texts.slice(start, i - start).to_pylist()]
                start, held = i, 0
            held += size or 0


def map_texts(docs: DataFrame, text: str, carry: dict[str, str | Column], fields: list[tuple[str, str, pa.DataType]], work, keep: bool = False) -> DataFrame:
    """``work(texts, batch) -> columns`` over every text, slice by slice; no shuffle.

    ``carry`` maps output names to input columns that pass through. ``fields`` are the names, Spark types
    and Arrow types of what ``work`` returns. With ``keep`` the last returned column is a mask that selects
    rows and is not part of the result.
    """
    plain = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"_in{i}") for i, c in enumerate(carry.values())], F.col(text).cast("string").alias("_text"))
    types = [f.dataType for f in plain.schema.fields[: len(carry)]]
    schema = ", ".join([f"`{n}` {t.simpleString()}" for n, t in zip(carry, types, strict=True)] + [f"`{n}` {s}" for n, s, _ in fields])
    names, kinds, taken = [*carry, *(n for n, _, _ in fields)], [k for _, _, k in fields], len(carry)

    def run(batches):
        for piece, texts in parts(batches, "_text"):
            made = work(texts, piece)
            mask = pa.array(made.pop(), pa.bool_()) if keep else None
            columns = [piece.column(i) for i in range(taken)]
            columns += [c if isinstance(c, pa.Array) else pa.array(c, type=k) for c, k in zip(made, kinds, strict=True)]
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out.filter(mask) if keep else out

    return plain.mapInArrow(run, schema)


def row_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
