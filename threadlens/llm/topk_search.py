"""Exact top-k search by inner product: columnar branch and bound.

Components are integers (floor of ``scale`` times the component). Queries and candidates are dealt by hash to
groups of bounded size, and every pair of groups is one cell of a grid: a task that holds its candidates in
vertical layout, one row per dimension. A cell scores a few long candidates first, which gives each query
a threshold. Then it adds inner products dimension block by dimension block; after each block a candidate
survives for a query only if its sum so far plus the product of what remains of both norms
(Cauchy-Schwarz) can still reach the threshold, and the survivors are compacted. Dimensions with the most mass
come first. Cells give at most k rows per query, which are ranked at the end; nothing approximates.

Rows are written once, with a number each, by which candidates are dealt: equal rows spread over the groups too.

Defined results: vectors that are null, or hold components that are null, not finite or not finite once scaled, and
rows with a null id take no part; missing components of shorter vectors count as 0; a query has fewer rows if
there are fewer candidates; ties go to the smaller id; rows that repeat an id are candidates of their own, never of a
query of their id, and one query (the smallest vector); scores beyond a long count as the nearest long. Other columns
are not read, so they may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.runtime import snapshot

K, SCALE, EVERY = 5, 256, 50
#: Rows of a cell's sides: at most about this many, as hashes spread them.
QUERY_ROWS, CANDIDATE_ROWS = 16_384, 8_192
BLOCK_DIMS, SEEDS, TOGETHER = 8, 256, 128
EXACT = 2.0**53


def usable(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(id, v): ids and vectors of the rows that take part."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null")
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf"))))


def _matrix(column: pa.ChunkedArray, dims: int, scale: float) -> np.ndarray:
    """rows x dims of floor(scale * component), as doubles; shorter vectors are filled with 0."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    values = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    out = np.zeros((len(lengths), dims))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = values
    return out


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher score, then smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, candidates: np.ndarray, k: int = K) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of every query; a query's own id is none."""
    largest = max(np.abs(queries).max(initial=0), np.abs(candidates).max(initial=0))
    if largest**2 * max(1, queries.shape[1]) >= EXACT:
        return _search_large(query_ids, queries, ids, candidates, k)
    order = np.argsort(-(candidates**2).sum(axis=0), kind="stable")
    longest = np.argsort(-(candidates**2).sum(axis=1), kind="stable")
    ids = ids[longest]
    vertical = np.ascontiguousarray(candidates[longest][:, order].T)
    queries = queries[:, order]
    edges = [*range(0, len(order), BLOCK_DIMS), len(order)] if len(order) else [0, 0]
    left = [np.sqrt((vertical[e:] ** 2).sum(axis=0)) for e in edges]
    query_left = np.stack([np.sqrt((queries[:, e:] ** 2).sum(axis=1)) for e in edges], axis=1)
    found = []
    for at in range(0, len(queries), TOGETHER):
        some = queries[at : at + TOGETHER]
        seeds = some @ vertical[:, :SEEDS]
        opening = some[:, : edges[1]] @ vertical[: edges[1]]
        for row, query in enumerate(some):
            name, rest = query_ids[at + row], query_left[at + row]
            others = seeds[row][ids[:SEEDS] != name]
            threshold = np.partition(others, len(others) - k)[len(others) - k] if len(others) >= k else -np.inf
            alive = np.flatnonzero((opening[row] + rest[1] * left[1] * (1 + 1e-9) + 1e-3 >= threshold) & (ids != name))
            sums = opening[row][alive]
            for step in range(1, len(edges) - 1):
                sums = sums + query[edges[step] : edges[step + 1]] @ vertical[edges[step] : edges[step + 1], alive]
                reach = sums + rest[step + 1] * left[step + 1][alive] * (1 + 1e-9) + 1e-3 >= threshold
                if not reach.all():
                    alive, sums = alive[reach], sums[reach]
            for i in best_of(ids[alive], sums, k):
                found.append((int(name), int(ids[alive[i]]), int(sums[i])))
    return found


def _search_large(query_ids, queries, ids, candidates, k) -> list[tuple[int, int, int]]:
    """For components whose products leave the doubles' exact range: whole numbers, without bounds."""
    whole = np.array([[int(x) for x in row] for row in candidates], dtype=object).reshape(candidates.shape)
    found = []
    for name, query in zip(query_ids, queries, strict=True):
        scores = whole @ np.array([int(x) for x in query], dtype=object) if len(query) else np.zeros(len(ids), dtype=object)
        nearest = [max(-(2**63), min(2**63 - 1, s)) for s in scores]
        ranked = sorted((-s, int(i)) for s, i in zip(nearest, ids, strict=True) if i != name)[:k]
        found += [(int(name), i, -s) for s, i in ranked]
    return found


def search(embeddings: DataFrame, k: int = K, scale: float = SCALE, every: int = EVERY, key: str = "vec_id", vector: str = "embedding", query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row whose id is divisible by ``every``."""
    rows = snapshot(usable(embeddings, key, vector, scale).withColumn("_at", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(F.col("id") % every == 0, F.col("id"))).alias("q")).first()
    query_groups, groups = max(1, -(-sizes["q"] // query_rows)), max(1, -(-sizes["n"] // candidate_rows))

    def numbers(count: int):
        return F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))

    # a row goes to one group of its side, and to every cell of that group
    once = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = once.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(query_groups)).alias("a"), F.explode(numbers(groups)).alias("b"))
    candidates = rows.select("id", "v", F.pmod(F.xxhash64("id", "_at"), F.lit(groups)).alias("b"), F.explode(numbers(query_groups)).alias("a"))

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dims = max(int(pc.max(pc.list_value_length(side["v"])).as_py()) for side in (left, right))
        found = search_cell(left["id"].to_numpy(), _matrix(left["v"], dims, scale), right["id"].to_numpy(), _matrix(right["v"], dims, scale), k)
        return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], schema=schema)

    cells = queries.groupBy("a", "b").cogroup(candidates.groupBy("a", "b")).applyInArrow(cell, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return cells.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
