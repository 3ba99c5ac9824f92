"""Ranks, running totals, exact percentiles and top-k that split hot groups.

A window ordered inside a group sends the whole group to one task. Here the rows
are range-partitioned by group *and* order, so a group of any size spreads over
many slices; each slice is ranked on its own and shifted by the totals of the
slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.runtime import snapshot

# Spark keeps ``n`` rows per group and map task before the shuffle of a row_number
# filter, and one task gets them all: with many map tasks only a small ``n`` is safe.
GROUP_LIMIT = 20


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe equi-join that keeps the key columns of the left side only."""
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_right_{k}" for k in keys])


def running_total(
    df: DataFrame,
    order: Sequence[Column],
    weight: str | None = None,
    group: Sequence[str] = (),
    name: str = "running",
    slices: int | None = None,
) -> DataFrame:
    """Add the total weight of the rows before each row of its group (0 for the first).

    ``order`` has to be total inside a group for a repeatable result.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    weight = F.col(weight) if weight else F.lit(1)
    keys = [f"_g{i}" for i in range(len(group))] + ["_slice"]

    keyed = df.select(
        "*",
        *[F.col(g).alias(k) for g, k in zip(group, keys)],
        weight.alias("_weight"),
    )
    ranged = keyed.repartitionByRange(slices, *[F.col(k) for k in keys[:-1]], *order)
    ranged = snapshot(ranged.withColumn("_slice", F.spark_partition_id()), "slices")

    totals = ranged.groupBy(*keys).agg(F.sum("_weight").alias("_total"))
    earlier = (
        Window.partitionBy(*(keys[:-1] or [F.lit(0)]))
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per group and slice: a window here holds at most ``slices`` rows.
    offsets = snapshot(
        totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")), "offsets"
    )

    inside = (
        Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        join_same(ranged, offsets, keys, "inner")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .drop(*keys, "_weight", "_offset")
    )


def rank_rows(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Exact 1-based rank inside a group, however large the group is."""
    ranked = running_total(df, order, group=group, name=name)
    return ranked.withColumn(name, F.col(name) + 1)


def first_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """At most the first ``n`` rows of each group.

    Small ``n`` uses a row_number filter, of which Spark keeps only ``n`` rows per
    group in each map task; larger ``n`` uses the sliced rank.
    """
    if n <= GROUP_LIMIT:
        window = Window.partitionBy(*group).orderBy(*order)
        ranked = df.withColumn("_rank", F.row_number().over(window))
    else:
        ranked = rank_rows(df, order, group, "_rank")
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def first_row(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each group, as an aggregate: partial minima, no window, no hot task."""
    others = [c for c in df.columns if c not in group and c not in order]
    packed = F.struct(*order, *others)
    kept = df.groupBy(*group).agg(F.min_by(packed, F.struct(*order)).alias("_first"))
    return kept.select(*[F.col(c) if c in group else F.col(f"_first.{c}") for c in df.columns])


def top_fraction(
    df: DataFrame, fraction: float, group: Sequence[str], order: Sequence[Column], name: str = "rank"
) -> DataFrame:
    """The first ``max(1, int(fraction * n))`` rows of every group of ``n`` rows."""
    ranked = rank_rows(df, order, group, name)
    sizes = snapshot(ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    quota = F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * F.col("_n")))
    return join_same(ranked, sizes, group, "inner").filter(F.col(name) <= quota).drop("_n")


def exact_percentiles(
    df: DataFrame, columns: Sequence[str], fractions: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per (by, metric).

    Columns ``p0, p1, ...`` follow ``fractions``. Equal values are merged before the
    shuffle, and no group of values is ever held by one task.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    ).alias("_pair")
    keys = [*by, "metric"]
    counts = (
        df.select(*by, pairs)
        .select(*by, "_pair.metric", "_pair.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    placed = running_total(counts, [F.col("value")], "_count", keys, "_start")
    sizes = snapshot(placed.groupBy(*keys).agg(F.sum("_count").alias("_n")), "group-sizes")
    placed = join_same(placed, sizes, keys, "inner")

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("_start") <= position, F.col("value")))

    bounds = []
    for i, q in enumerate(fractions):
        position = F.lit(float(q)) * (F.col("_n") - 1)
        bounds += [
            at(F.floor(position)).alias(f"_low{i}"),
            at(F.ceil(position)).alias(f"_high{i}"),
            F.max(position - F.floor(position)).alias(f"_part{i}"),
        ]
    found = placed.groupBy(*keys).agg(*bounds)
    return found.select(
        *keys,
        *[
            (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")).alias(f"p{i}")
            for i in range(len(fractions))
        ],
    )
