import numpy as np
import pytest

from threadlens.llm import topk_search as op


def brute(rows, k=5, every=50, scale=256):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(float(x) * scale) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    ints = [(i, [int(np.floor(float(x) * scale)) for x in v] + [0] * (dims - len(v))) for i, v in ok]
    out = []
    least = {}
    for (i, v), (_, whole) in zip(ok, ints, strict=True):
        least[i] = min(least.get(i, (v, whole)), (v, whole))
    for i, (_, q) in least.items():
        if i % every == 0:
            scores = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=True)))), j) for j, v in ints if j != i]
            ranked = sorted((-s, j) for s, j in scores)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")


@pytest.mark.parametrize("candidate_rows", [7, 1000])
def test_equals_brute_force(spark, candidate_rows):
    random = np.random.default_rng(3)
    data = [(i, random.normal(size=12).round(2).tolist()) for i in range(160)]
    data += [(1000 + i, data[50][1]) for i in range(20)]  # ties
    data += [(None, [1.0] * 12), (150, None), (3000, [None] * 12), (3050, [float("nan")] * 12), (3100, [float("inf")] * 12), (3150, [1.0, 2.0]), (3200, [])]
    got = op.search(frame(spark, data), query_rows=3, candidate_rows=candidate_rows)
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_repeated_rows(spark):
    random = np.random.default_rng(5)
    data = [(i, random.normal(size=6).round(2).tolist()) for i in range(120)]
    data += [data[50]] * 9 + [data[7]] * 40 + [(100, [0.5] * 6)]
    got = op.search(frame(spark, data), query_rows=3, candidate_rows=11)
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_equal_rows_spread_over_the_cells(spark, monkeypatch):
    data = [(1, [1.0, 2.0])] * 4000 + [(0, [1.0, 1.0])]
    sizes, inner = spark.sparkContext.accumulator(0), op.search_cell

    def cell(*args, **kwargs):
        assert len(args[2]) < 1500
        sizes.add(len(args[2]))
        return inner(*args, **kwargs)

    monkeypatch.setattr(op, "search_cell", cell)
    assert [tuple(r) for r in op.search(frame(spark, data), candidate_rows=500).collect()] == [(0, k, 1, 256 * 256 * 3) for k in range(1, 6)]
    assert sizes.value == 4001


def test_large_components_and_few_rows(spark):
    data = [(0, [1e18, 2e18]), (1, [3e17, 1e18]), (2, [-1e18, 5e18]), (3, [1e307, 0.0]), (50, [1e300, 1.0])]
    assert sorted(map(tuple, op.search(frame(spark, data)).collect())) == brute(data)
    assert sorted(map(tuple, op.search(frame(spark, [(0, [1.0])])).collect())) == []
    assert op.search(frame(spark, [])).count() == 0


def test_bounds_cut_but_lose_nothing():
    random = np.random.default_rng(1)
    base = random.normal(size=(40, 64)) * 200
    vectors = np.floor(base[random.integers(0, 40, 900)] + random.normal(size=(900, 64)) * 20)
    ids = np.arange(900)
    got = op.search_cell(ids[::30], vectors[::30], ids, vectors)
    want = []
    for i in range(0, 900, 30):
        scores = vectors @ vectors[i]
        order = [j for j in np.lexsort((ids, -scores)) if j != i][:5]
        want += [(i, int(j), int(scores[j])) for j in order]
    assert got == want
