"""One large file read by many tasks: arrays of JSON objects, and CSV with line breaks inside quotes.

Spark's own readers give such a file to one task, as nothing in the middle of it says whether a quote is open. Here it is
read as stretches between closing braces (JSON) or line ends (CSV), which Spark splits anywhere. Each split counts its
quotes, and its braces for both cases; sums over the splits before it then say in which state it starts. A second pass
cuts the records; those that cross splits are put together from their pieces, two a split at most.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.runtime import snapshot
from threadlens.sources.writers import CSV, json_as_nested

ESCAPED = re.compile(r"\\.", re.S)
SPLIT, PIECE = "file string, start long, quotes long, outside long, inside long", "file string, start long, kind int, text string"
#: Kinds of cut text: a whole record, and the end, middle or beginning of one that crosses splits.
WHOLE, END, MIDDLE, BEGINNING = range(4)


class _Rules:
    """What a stretch does to the state (inside a quote, depth of braces)."""

    def __init__(self, json: bool):
        self.json, self.separator = json, "}" if json else "\n"

    def quotes(self, value: str) -> list[str]:
        return (ESCAPED.sub("", value) if self.json and "\\" in value else value).split('"')

    def deeper(self, parts: list[str], inside: int) -> int:
        """Change of depth over a stretch and the separator behind it, if it starts ``inside`` a quote or not."""
        if not self.json:
            return 0
        ends_inside = inside ^ (len(parts) - 1) & 1
        return sum(part.count("{") for part in parts[inside::2]) - (not ends_inside)


def _measure(rules: _Rules):
    """One row a split: quotes, and change of depth for a start outside and inside a quote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, [0, 0, 0]
        for batch in batches:
            for file, start, value in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, start) != at:
                    if at is not None:
                        yield _batch(SPLIT, [(*at, *sums)])
                    at, sums = (file, start), [0, 0, 0]
                parts = rules.quotes(value)
                # the state inside the split, for either start
                for case in (0, 1):
                    sums[1 + case] += rules.deeper(parts, case ^ sums[0] & 1)
                sums[0] += len(parts) - 1
        if at is not None:
            yield _batch(SPLIT, [(*at, *sums)])

    return run


def _cut(rules: _Rules):
    """Records and pieces of records of every split, from the state it starts in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, depth, crossing = None, [], 0, 0, False
        for batch in batches:
            out = []
            for file, start, value, first_inside, first_depth in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (file, start) != at:
                    if held:
                        out.append((*at, MIDDLE if crossing else BEGINNING, "".join(held)))
                    at, held, inside, depth = (file, start), [], first_inside, first_depth
                    crossing = bool(inside or depth)
                parts = rules.quotes(value)
                change, ends_inside = rules.deeper(parts, inside), inside ^ (len(parts) - 1) & 1
                if rules.json and not held and not crossing:
                    begin = value.find("{")
                    if begin < 0:  # between records, or behind the last one
                        inside = ends_inside
                        continue
                    value = value[begin:]
                held.append(value + rules.separator)
                inside, depth = ends_inside, depth + change
                if not inside and depth <= 0:
                    out.append((*at, END if crossing else WHOLE, "".join(held)))
                    held, depth, crossing = [], 0, False
            if out:
                yield _batch(PIECE, out)
        if held:
            yield _batch(PIECE, [(*at, MIDDLE if crossing else BEGINNING, "".join(held))])

    return run


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def record_texts(spark: SparkSession, path: str | list[str], json: bool) -> DataFrame:
    """(file, start, text) of every record; ``start`` is the byte at which the split begins that the record begins in."""
    rules = _Rules(json)
    lines = spark.read.option("lineSep", rules.separator).text(path)
    stretches = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    splits = stretches.mapInArrow(_measure(rules), SPLIT)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    opened = splits.withColumn("open", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int"))
    own = F.when(F.col("open") == 1, F.col("inside")).otherwise(F.col("outside"))
    states = snapshot(opened.withColumn("depth", F.coalesce(F.sum(own).over(before), F.lit(0))).select("file", "start", "open", "depth"), "splits")
    # sorted again, so that the order holds whichever way the states come
    placed = stretches.withColumn("_n", F.monotonically_increasing_id()).join(states, ["file", "start"]).sortWithinPartitions("file", "start", "_n")
    cut = snapshot(placed.select("file", "start", "value", "open", "depth").mapInArrow(_cut(rules), PIECE), "records")
    crossing = cut.where(F.col("kind") != WHOLE)
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = crossing.withColumn("_of", F.sum(F.when(F.col("kind") == BEGINNING, 1).otherwise(0)).over(order))
    joined = numbered.groupBy("file", "_of").agg(F.min("start").alias("start"), F.sort_array(F.collect_list(F.struct("start", "kind", "text"))).alias("parts"))
    rebuilt = joined.select("file", "start", F.array_join(F.col("parts.text"), "").alias("text"))
    return cut.where(F.col("kind") == WHOLE).select("file", "start", "text").unionByName(rebuilt)


def read_json_array(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Objects of JSON arrays (or of JSON lines), whatever the size of a file; unreadable objects are rows of nulls."""
    return record_texts(spark, path, True).select(F.from_json("text", schema).alias("_r")).select("_r.*")


def read_csv_records(spark: SparkSession, path: str | list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """Rows of CSV files as ``write_csv`` writes them, line breaks in quotes included, whatever the size of a file."""
    nested = T.ArrayType | T.MapType | T.StructType
    flat = T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, nested) else f.dataType) for f in schema])
    records = record_texts(spark, path, False).withColumn("text", F.regexp_replace("text", r"\r?\n\z", "")).where("text <> ''")
    options = {k: str(v) for k, v in CSV.items() if k != "header"}
    if header:
        names = ",".join(schema.names)
        records = records.where((F.col("start") > 0) | (F.regexp_replace("text", '"', "") != names))
    return json_as_nested(records.select(F.from_csv("text", flat.simpleString()[len("struct<") : -1].replace(":", " "), options).alias("_r")).select("_r.*"), schema)
