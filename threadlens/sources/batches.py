"""Batches that count once: a folder per try, and a commit that names the folder which counts.

A batch is first written to a folder of its own, then committed by one small file, put in place by a rename
that fails if the batch has one already. Readers take the folders named by commits and nothing else: a
batch that broke off is never read, and one that is written again, after a failure or by a second job, is read once.
"""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.sources.writers import CSV, json_as_nested, nested_as_json

FORMATS = ("parquet", "json", "csv")
NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
#: Folders of a try are partition columns, so that one scan reads many of them.
BATCH, TRY = "_of_batch", "_of_try"


class _Files:
    """The few calls of the shared file system that commits need."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._files.open(self._path(path))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_new(self, path: str, text: str, draft: str) -> bool:
        """Write ``text`` beside and move it to ``path``; False if something is there already."""
        place = self._path(path)
        self._files.mkdirs(place.getParent())
        stream = self._files.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        # a local rename would replace the file, so its absence is looked at first as well
        moved = not self._files.exists(place) and self._files.rename(self._path(draft), place)
        if not moved:
            self._files.delete(self._path(draft), False)
        return bool(moved)

    def delete(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def write_batch(df: DataFrame, root: str, batch: str, format: str = "parquet", partition_by: list[str] | None = None) -> bool:
    """Write a batch and commit it; False, and nothing added, if the batch has been committed before."""
    if format not in FORMATS:
        raise ValueError(f"format is one of {FORMATS}")
    if not NAME.fullmatch(batch):
        raise ValueError("a batch is named by letters, digits, '.', '_' and '-'")
    root = root.rstrip("/")
    files = _Files(df.sparkSession, root)
    commit = f"{root}/commits/{batch}.json"
    if files.exists(commit):
        return False
    folder = f"{BATCH}={batch}/{TRY}={uuid.uuid4().hex}"
    rows = nested_as_json(df) if format == "csv" else df
    writer = rows.write.format(format).options(**(CSV if format == "csv" else {}))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(f"{root}/tries/{folder}")
    note = {"folder": folder, "format": format, "schema": df.schema.jsonValue(), "partition_by": partition_by or []}
    return files.put_new(commit, json.dumps(note), f"{root}/tries/{folder}.commit")


def committed(spark: SparkSession, root: str) -> dict[str, dict]:
    """Commits by batch, one small file each."""
    root = root.rstrip("/")
    files = _Files(spark, root)
    return {name[:-5]: json.loads(files.read(f"{root}/commits/{name}")) for name in files.names(f"{root}/commits") if name.endswith(".json")}


def read_batches(spark: SparkSession, root: str, batches: list[str] | None = None, name: str = "batch") -> DataFrame:
    """Rows of all committed batches (or some), with the batch each came from.

    Batches of one format and schema are one scan; columns that a batch doesn't have are null.
    """
    root = root.rstrip("/")
    found = committed(spark, root)
    if batches is not None:
        missing = sorted(set(batches) - set(found))
        if missing:
            raise ValueError(f"not committed: {missing}")
        found = {b: found[b] for b in batches}
    if not found:
        raise ValueError(f"no batch has been committed under {root}")
    alike: dict[str, list[str]] = {}
    for note in found.values():
        alike.setdefault(json.dumps([note["format"], note["schema"], note["partition_by"]]), []).append(note["folder"])
    frames = [_scan(spark, root, folders, *json.loads(kind), name) for kind, folders in alike.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _scan(spark: SparkSession, root: str, folders: list[str], format: str, fields: dict, partition_by: list[str], name: str) -> DataFrame:
    """All tries of one format, schema and layout."""
    schema = T.StructType.fromJson(fields)
    nested = T.ArrayType | T.MapType | T.StructType
    stored = [T.StructField(f.name, T.StringType() if format == "csv" and isinstance(f.dataType, nested) else f.dataType) for f in schema]
    inside = [f for f in stored if f.name not in partition_by]
    folded = [T.StructField(BATCH, T.StringType()), T.StructField(TRY, T.StringType()), *(f for f in stored if f.name in partition_by)]
    reader = spark.read.schema(T.StructType([*inside, *folded])).format(format).options(**(CSV if format == "csv" else {}))
    rows = reader.option("basePath", f"{root}/tries").load([f"{root}/tries/{folder}" for folder in folders])
    if format == "csv":
        rows = json_as_nested(rows, schema)
    return rows.select(*[f.name for f in schema], F.col(BATCH).alias(name))


def drop_uncommitted(spark: SparkSession, root: str) -> int:
    """Delete tries that no commit names; call it when no batch is being written."""
    root = root.rstrip("/")
    files, kept = _Files(spark, root), {note["folder"] for note in committed(spark, root).values()}
    gone = 0
    for batch in files.names(f"{root}/tries"):
        for name in files.names(f"{root}/tries/{batch}"):
            if f"{batch}/{name}" not in kept and not name.startswith("."):
                files.delete(f"{root}/tries/{batch}/{name}")
                gone += 1
    return gone
