"""Reading posts, communities and raw listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.schemas import COMMUNITIES, POSTS, RAW_COMMENT, RAW_SUBMISSION
from threadlens.sources.splits import read_csv_records, read_json_array


def _nested(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]


def read_posts(spark: SparkSession, path, format: str = "parquet", array: bool = False, split: bool = False) -> DataFrame:
    """Posts from Parquet, JSON or CSV.

    ``json`` reads one record per line, as ``write_posts`` writes it and as large files
    split; with ``array`` it reads one array of records per file. ISO text becomes a
    timestamp by schema. An array file, or a CSV file, is one task; with ``split`` many
    tasks read it, in two passes.
    """
    if split and (format == "csv" or format == "json" and array):
        return read_json_array(spark, path, POSTS) if format == "json" else read_csv_records(spark, path, POSTS)
    if format == "parquet":
        return spark.read.schema(POSTS).parquet(path)
    if format == "json":
        return spark.read.schema(POSTS).option("multiLine", array).json(path)
    if format == "csv":
        nested = {f.name: f.dataType for f in _nested(POSTS)}
        flat = T.StructType(
            [T.StructField(f.name, T.StringType() if f.name in nested else f.dataType) for f in POSTS.fields]
        )
        raw = (
            spark.read.schema(flat)
            .option("header", True)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
        return raw.withColumns({name: F.from_json(name, kind) for name, kind in nested.items()})
    raise ValueError("format is 'parquet', 'json' or 'csv'")


def read_communities(spark: SparkSession, path) -> DataFrame:
    return (
        spark.read.schema(COMMUNITIES)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
        .na.fill("", ["description"])
    )


def read_submissions(spark: SparkSession, path) -> DataFrame:
    """Raw submissions, one JSON record per line."""
    return spark.read.schema(RAW_SUBMISSION).json(path)


def read_comments(spark: SparkSession, path) -> DataFrame:
    """Raw comments, one JSON record per line."""
    return spark.read.schema(RAW_COMMENT).json(path)
