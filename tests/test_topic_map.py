import math

import numpy as np
import pytest

from threadlens.operators import topic_map as op

SCHEMA = "topic_id int, word string, prob double"


def brute(p, q):
    words = set(p) | set(q)
    p, q = ({w: x / sum(t.values()) for w, x in t.items()} for t in (p, q))
    total = 0.0
    for w in words:
        a, b = p.get(w, 0), q.get(w, 0)
        m = (a + b) / 2
        total += (a * math.log(a / m) if a else 0) + (b * math.log(b / m) if b else 0)
    return total / 2


def test_divergences_equal_plain_loops(spark):
    random = np.random.default_rng(2)
    tables = {t: {f"w{w}": float(random.random()) for w in random.choice(40, 20, replace=False)} for t in range(5)}
    tables[7] = {"alone": 3.0}
    rows = [(t, w, p) for t, table in tables.items() for w, p in table.items()] + [(0, "zero", 0.0), (9, "zero", 0.0)]
    got = {(r.a, r.b): r.divergence for r in op.topic_divergences(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(a, b): pytest.approx(brute(tables[a], tables[b])) for a in tables for b in tables if a < b}
    assert got[0, 7] == pytest.approx(math.log(2))


def test_equal_topics_and_none(spark):
    same = spark.createDataFrame([(0, "a", 1.0), (0, "b", 1.0), (1, "a", 5.0), (1, "b", 5.0)], SCHEMA)
    assert [tuple(r) for r in op.topic_divergences(same).collect()] == [(0, 1, pytest.approx(0.0, abs=1e-12))]
    assert [(r.x0, r.x1) for r in op.topic_map(same).collect()] == [pytest.approx((0, 0), abs=1e-6)] * 2
    assert op.topic_divergences(same.limit(0)).count() == 0 and op.topic_map(same.limit(0)).count() == 0
    one = op.topic_map(same.where("topic_id = 0")).collect()
    assert [tuple(r) for r in one] == [(0, 1.0, 0.0, 0.0)]


def test_a_planted_layout_comes_back():
    points = np.array([[0.0, 0.0], [4.0, 0.0], [4.0, 3.0], [-1.0, 2.0], [2.0, 7.0]])
    distances = np.linalg.norm(points[:, None] - points[None], axis=2)
    placed = op.principal_coordinates(distances)
    assert np.linalg.norm(placed[:, None] - placed[None], axis=2) == pytest.approx(distances)
    assert placed.mean(axis=0) == pytest.approx([0, 0])
    assert (placed[:, 0] ** 2).sum() >= (placed[:, 1] ** 2).sum()
    assert op.principal_coordinates(distances, 4)[:, 2:] == pytest.approx(0, abs=1e-6)


def test_shares_of_texts(spark):
    weights = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "b", 0.5), (1, "c", 0.5), (2, "d", 1.0)], SCHEMA)
    shares = spark.createDataFrame([(0, 0.75), (1, 0.25), (0, 1.0)], "topic_id int, prob double")
    got = {r.topic_id: r.share for r in op.topic_map(weights, shares).collect()}
    assert got == {0: 0.875, 1: 0.125, 2: None}
