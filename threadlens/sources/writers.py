"""Writing posts, details, summaries and graphs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators.leaders import outliers
from threadlens.operators.metrics import describe_exact
from threadlens.operators.selection import by_subscribers

# White space and quotes survive the trip. Empty text and null are the same in CSV.
CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
NESTED = (T.ArrayType, T.MapType, T.StructType)


def versioned_name(folder: str, label: str, run_id: str | None = None, at: datetime | None = None) -> str:
    """``folder/<timestamp>[_<run id>]_<label>``."""
    stamp = (at or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")
    parts = [stamp, *([run_id] if run_id else []), label]
    return f"{folder.rstrip('/')}/{'_'.join(parts)}"


def nested_as_json(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for flat formats."""
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, NESTED)]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def json_as_nested(df: DataFrame, schema: T.StructType) -> DataFrame:
    nested = [f for f in schema.fields if isinstance(f.dataType, NESTED) and f.name in df.columns]
    return df.withColumns({f.name: F.from_json(f.name, f.dataType) for f in nested})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", files: int | None = None) -> None:
    flat = nested_as_json(df)
    if files:
        flat = flat.coalesce(files)
    flat.write.mode(mode).options(**CSV).csv(path)


def write_posts(
    posts: DataFrame,
    path: str,
    format: str = "parquet",
    mode: str = "append",
    by_community: bool = False,
    run_id: str | None = None,
) -> bool:
    """Append posts as Parquet, JSON or CSV; an empty JSON batch is skipped.

    ``by_community`` lays the files out per community in one job, ``run_id`` adds
    the batch that wrote a row.
    """
    if run_id:
        posts = posts.withColumn("run_id", F.lit(run_id))
    if format == "json" and posts.isEmpty():
        return False
    if format == "csv":
        posts = nested_as_json(posts)
    elif format not in ("parquet", "json"):
        raise ValueError("format is 'parquet', 'json' or 'csv'")
    writer = posts.write.mode(mode)
    if format == "csv":
        writer = writer.options(**CSV)
    if by_community:
        writer = writer.partitionBy("subreddit")
    writer.format(format).save(path)
    return True


def write_details(details: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Community details by subscribers; the files in name order are the sorted list."""
    write_csv(by_subscribers(details), path, mode)


def write_summary(metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_csv(describe_exact(metrics, [c for c in metrics.columns if c != "post_author"]), path, mode, files=1)


def write_outliers(scored: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    found = outliers(scored)
    if found is None:
        return False
    write_csv(found, path, mode)
    return True


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    nodes.write.mode(mode).parquet(f"{path}/nodes")
    edges.write.mode(mode).parquet(f"{path}/edges")
