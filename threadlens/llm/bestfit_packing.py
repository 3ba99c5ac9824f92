"""Best-fit packing under conflicts: no bin holds two pieces of one source or of one duplicate cluster.

Texts are cut into pieces of at most ``capacity`` (sizes are UTF-8 bytes plus one end mark for the text, or any
column); full pieces take a bin alone. The rest are dealt by a hash of their key to groups of bounded size,
whose number grows with the data, and each group is packed by itself: largest first, open bins ordered by
residual, each with a bitmap of its sources and one of its clusters. The search starts at the smallest
residual that fits and goes on to its successors until a bin without a conflict is found: the tightest
compatible bin. Dealing by hash spreads a source or cluster that holds a third of all rows over all groups.

Clusters are equal texts after lower-casing and joining white space, unless a column is named.
Defined results: every row is packed, repeated rows too (they are told apart by ``copy``); null text counts as
empty and takes one end mark; null sources and null clusters conflict with nothing; of equal residuals the
older bin is taken; a missing size or one below 1 counts as 1; an empty table gives no bins. Only named columns are read, so others may clash.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 8192
#: Pieces of a group, about: what one task packs at once.
GROUP_ROWS = 4_000

#: Keys and clusters go through pandas as text: they may be null, and 64-bit values stay whole.
SCHEMA = "doc_id string, copy long, piece int, start long, size long, source string, cluster string, bin string, residual long, place int"


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """The bin of each item, in the order given, and what stays free in each bin."""
    source_bits: dict = {}
    cluster_bits: dict = {}
    free: list[int] = []
    held: list[tuple[int, int]] = []  # bitmaps of each bin: sources, clusters
    order: list[tuple[int, int]] = []  # (residual, bin), smallest first
    bins = []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s = 0 if source is None else 1 << source_bits.setdefault(source, len(source_bits))
        c = 0 if cluster is None else 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (held[order[at][1]][0] & s or held[order[at][1]][1] & c):
            at += 1
        if at < len(order):
            number = order.pop(at)[1]
        else:
            number = len(free)
            free.append(capacity)
            held.append((0, 0))
        free[number] -= size
        held[number] = (held[number][0] | s, held[number][1] | c)
        if free[number]:
            insort(order, (free[number], number))
        bins.append(number)
    return bins, free


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes and one end mark."""
    return F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long") + 1


def text_cluster(text: str = "text") -> Column:
    """Equal for texts that differ in case and white space only; null for null."""
    body = F.col(text).cast("string")
    return F.when(body.isNotNull(), F.xxhash64(F.trim(F.regexp_replace(F.lower(body), r"\s+", " "))))


def pieces(docs: DataFrame, capacity: int, key: str, size: Column, source: str, cluster: Column) -> DataFrame:
    """One row per piece: full ones first, then what is left."""
    rows = docs.select(F.col(key).alias("doc_id"), F.greatest(size.cast("long"), F.lit(1).cast("long")).alias("_size"), F.col(source).cast("string").alias("source"), cluster.cast("long").alias("cluster"))
    count = F.ceil(F.col("_size") / F.lit(capacity)).cast("int")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("long") * capacity
    return cut.withColumn("start", start).withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("_size") - start)).drop("_size")


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", source: str = "source", cluster: Column | None = None, size: Column | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per piece: key, copy, piece, start and size in the text, bin, what the bin has left, place in the bin."""
    from threadlens.runtime import snapshot

    cut = snapshot(pieces(docs, capacity, key, text_size(text) if size is None else size, source, text_cluster(text) if cluster is None else cluster), "pieces")
    total = cut.count()
    groups = max(1, -(-total // group_rows))
    group = F.pmod(F.xxhash64("doc_id", "piece", "size", "source", "cluster"), F.lit(groups))
    repeats = cut.groupBy("doc_id", "piece", "size", "source", "cluster", "start").agg(F.count(F.lit(1)).alias("copies"))
    # identical rows become one row with a count before the shuffle; they are dealt on by their copy number
    each = repeats.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    dealt = each.select("doc_id", "copy", "piece", "start", "size", "source", "cluster", F.pmod(group + F.col("copy"), F.lit(groups)).cast("long").alias("group"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["size", "doc_id", "piece", "copy", "source", "cluster"], ascending=[False, True, True, True, True, True], na_position="last").reset_index(drop=True)
        number, blank = int(frame["group"].iloc[0]), None
        bins, free = best_fit(
            frame["size"].tolist(),
            [blank if pd.isna(x) else x for x in frame["source"]],
            [blank if pd.isna(x) else x for x in frame["cluster"]],
            capacity,
        )
        frame["bin"] = [f"{number}-{b}" for b in bins]
        frame["residual"] = [free[b] for b in bins]
        frame["place"] = frame.groupby("bin").cumcount().astype("int32")
        return frame.drop(columns="group")

    carried = dealt.withColumn("cluster", F.col("cluster").cast("string")).withColumn("doc_id", F.col("doc_id").cast("string"))
    packed = carried.groupBy("group").applyInPandas(run, SCHEMA)
    return packed.select(F.col("doc_id").cast(docs.schema[key].dataType).alias(key), *[c for c in packed.columns if c not in ("doc_id", "cluster")], F.col("cluster").cast("long"))
