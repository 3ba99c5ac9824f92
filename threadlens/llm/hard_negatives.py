"""Hard negatives by inner product: STR-packed R-trees searched best first.

Rows are sorted by label and first component and cut into tiles of about ``tile_rows`` rows, which are written once.
A tile is packed by sort-tile-recursive into an R-tree: label first, then the components that spread most. A box holds
the least and greatest label and component of its rows, so for an anchor every coordinate gives an interval
of products, and their sums bound the score of every row in the box. Boxes wait in a queue by their greatest possible
score. A box is dropped if its interval lies outside every score window, if its labels are none that are sought,
or if it is strictly below the k-th score found in every window; the search ends when the best box is.

Two rounds over the tiles: the first finds an anchor's positives (same label, no window), the second its
negatives, one window for each positive, all in one search. Anchors are dealt in groups, and a task holds one group
and one tile; it returns k rows for every window, which are ranked at the end. Nothing approximates.

Components are floor(scale * component), as doubles. Sums beyond a double's whole numbers are made with Python's
integers, and scores beyond a long count as the nearest long.

Defined results: rows with a null id, label or vector, or a component that is null, not finite or not finite once
scaled, take no part. Missing components of shorter vectors count as 0. Rows that repeat an id are candidates of
their own, never partners of an anchor of their id, and one anchor (the smallest label, then vector). Positives with
a score below 0 have an empty window. Ties go to the smaller id. Other columns are not read, so they may clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.runtime import snapshot

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 5, 256
#: A negative's score lies between these percentages of the positive's.
LEAST_PERCENT, MOST_PERCENT = 80, 100
#: Rows of a tile and anchors of a group, about; rows of a leaf and children of a box.
TILE_ROWS, ANCHOR_ROWS, LEAF_ROWS, CHILDREN = 8_192, 16_384, 64, 16
#: Anchors whose boxes are bounded by one matrix product.
TOGETHER = 128
EXACT = 2.0**53
LONGEST = 2**63 - 1


def usable(embeddings: DataFrame, scale: float = SCALE, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v): the rows that take part, v scaled."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and label is not null and v is not null").withColumn("v", F.transform("v", lambda x: x * scale))
    return rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def tiles(rows: DataFrame, tile_rows: int = TILE_ROWS) -> tuple[DataFrame, int]:
    """Written rows with their ``tile`` (0 to the number of tiles - 1); equal rows are parted by their place."""
    wanted = max(1, -(-rows.count() // tile_rows))
    placed = rows.withColumn("_first", F.get("v", F.lit(0))).withColumn("_place", F.monotonically_increasing_id())
    dealt = placed.repartitionByRange(wanted, "label", "_first", "id", "_place").select(F.spark_partition_id().cast("long").alias("tile"), "id", "label", "v")
    tiled = snapshot(dealt, "tiles")
    return tiled, 1 + (tiled.agg(F.max("tile")).first()[0] or 0)


@dataclass
class Boxes:
    """An R-tree over one tile: boxes of all levels, leaves first, the root last."""

    ids: np.ndarray
    labels: np.ndarray
    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    low_label: np.ndarray
    high_label: np.ndarray
    begin: np.ndarray  # of a leaf: its rows; of another box: its children
    end: np.ndarray
    leaves: int


def tile_order(columns: list[np.ndarray], rows: np.ndarray, capacity: int, depth: int = 0) -> list[np.ndarray]:
    """Sort-tile-recursive: leaves of at most ``capacity`` rows."""
    count = -(-len(rows) // capacity)
    if count <= 1:
        return [rows]
    ways = max(2, int(np.ceil(count ** (1 / max(1, len(columns) - depth)))))
    per = capacity * -(-count // ways)
    rows = rows[np.argsort(columns[depth % len(columns)][rows], kind="stable")]
    return [leaf for at in range(0, len(rows), per) for leaf in tile_order(columns, rows[at : at + per], capacity, depth + 1)]


def pack(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, leaf_rows: int = LEAF_ROWS, children: int = CHILDREN) -> Boxes:
    """The R-tree of one tile (at least one row)."""
    spread = (points.max(axis=0) - points.min(axis=0)).astype(float) if points.shape[1] else np.zeros(0)
    columns = [labels, *(points[:, c] for c in np.argsort(-spread, kind="stable"))]
    leaves = tile_order(columns, np.arange(len(ids)), leaf_rows)
    order = np.concatenate(leaves)
    ids, labels, points = ids[order], labels[order], points[order]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in leaves])])
    begin, end = [edges[:-1]], [edges[1:]]
    level = [(points, points, labels, labels)]
    made: list[tuple] = []
    offset = 0
    while True:
        low, high, low_label, high_label = level[-1]
        cuts = begin[-1] - (offset if made else 0)
        made.append((np.minimum.reduceat(low, cuts, axis=0), np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(low_label, cuts), np.maximum.reduceat(high_label, cuts)))
        level.append(made[-1])
        count = len(cuts)
        offset = sum(len(m[2]) for m in made) - count
        if count == 1:
            break
        begin.append(np.arange(0, count, children) + offset)
        end.append(np.minimum(begin[-1] + children, offset + count))
    joined = [np.concatenate([m[c] for m in made]) for c in range(4)]
    return Boxes(ids, labels, points, *joined, np.concatenate(begin), np.concatenate(end), len(leaves))


def _long(scores: np.ndarray) -> np.ndarray:
    """Whole numbers of Python are held to a long; doubles are exact as they are."""
    return np.clip(scores, -LONGEST - 1, LONGEST) if scores.dtype == object else scores


def best_first(tree: Boxes, anchor: np.ndarray, name: int, own: int, same: bool, windows: list[tuple], k: int, upper: np.ndarray, lower: np.ndarray) -> list[list[tuple]]:
    """For each window (least, most score) the k best rows of the anchor's own label, or of the others: (score, -id)."""
    found: list[list[tuple]] = [[] for _ in windows]
    highest = max((most for _, most in windows), default=-np.inf)

    def needed() -> float:
        # the least score that still changes a window
        return min(heap[0][0] if len(heap) == k else least for heap, (least, _) in zip(found, windows, strict=True))

    def sought(box: int) -> bool:
        low, high = tree.low_label[box], tree.high_label[box]
        return low <= own <= high if same else not low == own == high

    root = len(upper) - 1
    queue = [(-upper[root], root)] if windows and k > 0 and sought(root) else []
    while queue:
        reach, box = heapq.heappop(queue)
        need = needed()
        if -reach < need:
            break
        begin, end = tree.begin[box], tree.end[box]
        if box >= tree.leaves:
            for child in range(begin, end):
                if upper[child] >= need and lower[child] <= highest and sought(child) and _open(upper[child], lower[child], found, windows, k):
                    heapq.heappush(queue, (-upper[child], child))
            continue
        scores = _long(tree.points[begin:end] @ anchor)
        labels, ids = tree.labels[begin:end], tree.ids[begin:end]
        fits = (scores >= need) & (scores <= highest) & ((labels == own) == same) & (ids != name)
        for score, row in zip(scores[fits].tolist(), ids[fits].tolist(), strict=True):
            entry = (score, -row)
            for heap, (least, most) in zip(found, windows, strict=True):
                if least <= score <= most:
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
    return found


def _open(upper, lower, found: list, windows: list[tuple], k: int) -> bool:
    """Whether a box can still change some window."""
    return any(lower <= most and upper >= (heap[0][0] if len(heap) == k else least) for heap, (least, most) in zip(found, windows, strict=True))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """rows x dims, rounded down; shorter vectors are filled with 0."""
    lists = column.combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), dims))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), place] = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    return out


def search_tile(anchors: pa.Table, rows: pa.Table, windows: list[list[tuple]], same: bool, k: int):
    """Yields (anchor's place, window, score, id) of the best rows of one tile."""
    dims = max(1, *(int(pc.max(pc.list_value_length(side["v"])).as_py()) for side in (anchors, rows)))
    asked, points = _matrix(anchors["v"], dims), _matrix(rows["v"], dims)
    if max(np.abs(asked).max(), np.abs(points).max()) ** 2 * dims >= EXACT:
        asked, points = (np.array([[int(x) for x in row] for row in side], dtype=object) for side in (asked, points))
    tree = pack(rows["id"].to_numpy(), rows["label"].to_numpy(), points)
    names, labels = anchors["id"].to_pylist(), anchors["label"].to_pylist()
    for at in range(0, len(asked), TOGETHER):
        some = asked[at : at + TOGETHER]
        plus, minus = np.where(some > 0, some, 0), np.where(some < 0, some, 0)
        # each coordinate's interval of products ends at a side of the box; the sums bound the score
        upper = _long(plus @ tree.high.T + minus @ tree.low.T)
        lower = _long(plus @ tree.low.T + minus @ tree.high.T)
        for i, anchor in enumerate(some):
            place = at + i
            found = best_first(tree, anchor, names[place], labels[place], same, windows[place], k, upper[i], lower[i])
            for window, heap in enumerate(found):
                for score, row in heap:
                    yield place, window, int(score), -row


def _cells(anchors: DataFrame, tiled: DataFrame, wanted: DataFrame, work, schema: str) -> DataFrame:
    """``work(anchors, rows)`` for every group of anchors and tile of ``wanted`` (group, tile)."""
    left = anchors.join(wanted, "a")
    right = tiled.join(wanted.select(F.col("a").alias("a"), F.col("tile").alias("tile")), "tile")
    return left.groupBy("a", "tile").cogroup(right.groupBy("a", "tile")).applyInArrow(work, schema)


def mine(
    embeddings: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
    most_percent: int = MOST_PERCENT,
    scale: float = SCALE,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tile_rows: int = TILE_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for all rows whose id is divisible by ``every``."""
    tiled, number = tiles(usable(embeddings, scale, key, vector, label), tile_rows)
    one = tiled.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.label", "r.v")
    groups = max(1, -(-one.count() // anchor_rows))
    dealt = snapshot(one.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(groups))), "anchors")

    # round 1: an anchor's label is in few tiles, and only those are read
    holders = tiled.select("tile", "label").distinct()
    wanted = snapshot(dealt.select("a", "label").distinct().join(holders, "label").select("a", "tile").distinct(), "cells")
    anywhere = [(-np.inf, np.inf)]

    def nearest(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _table([], POSITIVE)
        names = anchors["id"].to_pylist()
        return _table([(names[p], row, score) for p, _, score, row in search_tile(anchors, rows, [anywhere] * len(names), True, positives)], POSITIVE)

    near = _cells(dealt, tiled, wanted, nearest, "anchor_id long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id"))
    near = snapshot(near.withColumn("place", place.cast("long")).where(F.col("place") <= positives), "positives")

    # round 2: every tile may hold negatives; an anchor brings its positives' scores in order of place
    scores = near.groupBy(F.col("anchor_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asking = dealt.join(scores, "id")
    every_tile = embeddings.sparkSession.range(groups * number).select((F.col("id") % groups).alias("a"), F.expr(f"id div {groups}").alias("tile"))

    def between(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        if not anchors.num_rows or not rows.num_rows:
            return _table([], NEGATIVE)
        names = anchors["id"].to_pylist()
        windows = [[(-(-least_percent * s // 100), most_percent * s // 100) for s in scores] for scores in anchors["scores"].to_pylist()]
        return _table([(names[p], window + 1, row, score) for p, window, score, row in search_tile(anchors, rows, windows, False, negatives)], NEGATIVE)

    hard = _cells(asking, tiled, every_tile, between, "anchor_id long, place long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    ranked = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return near.join(ranked, ["anchor_id", "place"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


POSITIVE = ("anchor_id", "positive_id", "positive_score")
NEGATIVE = ("anchor_id", "place", "negative_id", "negative_score")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({name: pa.array([row[i] for row in rows], pa.int64()) for i, name in enumerate(names)})
