import numpy as np
import pytest

from threadlens.llm import hard_negatives as op
from threadlens.llm.queries import op13_hard_negatives

LONG = 2**63 - 1


def brute(rows, every=100, positives=5, negatives=5, scale=256):
    usable = []
    for i, v, g in rows:
        if i is not None and g is not None and v is not None and all(x is not None and np.isfinite(x) and np.isfinite(float(x) * scale) for x in v):
            usable.append((i, g, [float(x) * scale for x in v]))
    dims = max((len(v) for _, _, v in usable), default=0)
    whole = lambda v: [int(np.floor(x)) for x in v] + [0] * (dims - len(v))
    anchors = {}
    for i, g, v in usable:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (g, v)), (g, v))
    found = []
    for i, (g, v) in anchors.items():
        a = whole(v)
        scored = [(max(-LONG - 1, min(LONG, sum(x * y for x, y in zip(a, whole(w), strict=True)))), j, h) for j, h, w in usable if j != i]
        near = sorted((-s, j) for s, j, h in scored if h == g)[:positives]
        for s, j in near:
            fits = sorted((-t, k) for t, k, h in scored if h != g and 80 * -s <= 100 * t <= 100 * -s)[:negatives]
            found += [(i, j, rank + 1, k, -s, -t) for rank, (t, k) in enumerate(fits)]
    return sorted(found)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, g, 1, 2.0, 3, 4) for i, v, g in rows], "vec_id long, embedding array<double>, label int, rank int, score double, tile long, id long")


def clustered(random, n, dims=16, labels=4):
    centres = random.normal(size=(6, dims))
    return [(int(i), (centres[random.integers(6)] + random.normal(size=dims) * 0.4).round(3).tolist(), int(random.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("tile_rows", "anchor_rows"), [(17, 2), (100_000, 100_000)])
def test_equals_brute_force(spark, tile_rows, anchor_rows):
    data = clustered(np.random.default_rng(5), 700)
    data += [(1000 + i, data[200][1], i % 3) for i in range(40)]  # ties across and within labels
    data += [data[300], data[300], data[7], (300, [0.5] * 16, 1)]  # repeated rows and an id with two vectors
    data += [(None, [1.0] * 16, 1), (1100, None, 1), (1200, [None] * 16, 1), (1300, [float("nan")] * 16, 2), (1400, [float("inf")] * 16, 2), (1500, [1.0] * 16, None)]
    data += [(1600, [2.0, 3.0], 1), (1700, [], 2), (1800, [0.0] * 16, 99)]  # short vectors, a label of its own
    got = op.mine(frame(spark, data), tile_rows=tile_rows, anchor_rows=anchor_rows)
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_many_labels_one_row_each_and_one_hot_label(spark):
    random = np.random.default_rng(8)
    data = [(i, v, 0 if i % 3 == 0 else i) for i, v, _ in clustered(random, 400, dims=3)]
    assert sorted(map(tuple, op.mine(frame(spark, data), tile_rows=31).collect())) == brute(data)


def test_large_components(spark):
    data = [(0, [1e18, 2e18], 1), (1, [3e17, 1e18], 1), (2, [1e18, 5e17], 2), (3, [3e8, 1e9], 1), (4, [2.9e17, 9e17], 2), (100, [5e7, 1e8], 3), (101, [1e300, 1e307], 3), (5, [1.0, 1e4], 3), (6, [1.0, 9e3], 4)]
    assert sorted(map(tuple, op.mine(frame(spark, data)).collect())) == brute(data)


def test_no_rows_and_no_partners(spark):
    assert op.mine(frame(spark, [])).count() == 0
    assert op.mine(frame(spark, [(0, [1.0], 1)])).count() == 0
    assert op.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)])).count() == 0
    assert sorted(map(tuple, op.mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)])).collect())) == [(0, 1, 1, 2, 65536, 58880)]


def test_boxes_hold_their_rows_and_bound_scores():
    random = np.random.default_rng(2)
    points, labels = np.floor(random.normal(size=(1500, 9)) * 256), random.integers(0, 7, 1500)
    tree = op.pack(np.arange(1500), labels, points, leaf_rows=20, children=4)
    assert sorted(tree.ids.tolist()) == list(range(1500)) and max(tree.end[: tree.leaves] - tree.begin[: tree.leaves]) <= 20
    anchor = np.floor(random.normal(size=9) * 256)
    plus, minus = np.where(anchor > 0, anchor, 0), np.where(anchor < 0, anchor, 0)
    upper, lower = tree.high @ plus + tree.low @ minus, tree.low @ plus + tree.high @ minus

    def rows(box):
        if box < tree.leaves:
            return list(range(tree.begin[box], tree.end[box]))
        return [r for child in range(tree.begin[box], tree.end[box]) for r in rows(child)]

    assert sorted(rows(len(upper) - 1)) == list(range(1500))
    for box in range(len(upper)):
        scores = tree.points[rows(box)] @ anchor
        assert lower[box] <= scores.min() and scores.max() <= upper[box]
        assert tree.low_label[box] == tree.labels[rows(box)].min() and tree.high_label[box] == tree.labels[rows(box)].max()


def test_search_leaves_boxes_unread():
    random = np.random.default_rng(4)
    points = np.floor(random.normal(size=(4000, 3)) * 256)
    tree = op.pack(np.arange(4000), np.zeros(4000, dtype=int), points)
    read = []

    class Points(np.ndarray):
        def __matmul__(self, other):
            read.append(len(self))
            return np.asarray(self) @ other

    tree.points = points[tree.ids].view(Points)
    anchor = points[0]
    plus, minus = np.where(anchor > 0, anchor, 0), np.where(anchor < 0, anchor, 0)
    found = op.best_first(tree, anchor, 0, 0, True, [(-np.inf, np.inf)], 5, tree.high @ plus + tree.low @ minus, tree.low @ plus + tree.high @ minus)
    scores = points @ anchor
    want = [j for j in np.lexsort((np.arange(4000), -scores)) if j != 0][:5]
    assert [-i for _, i in sorted(found[0], reverse=True)] == want
    assert sum(read) < 1000


def test_query_swaps_labels(spark, tmp_path):
    data = clustered(np.random.default_rng(9), 420, labels=10)
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = brute([(i, v, (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in data])
    assert sorted(map(tuple, op13_hard_negatives(spark, str(tmp_path)).collect())) == want and want
