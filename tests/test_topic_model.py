import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import corpus, topics
from threadlens.operators import topic_model as op


def test_digamma_and_trigamma():
    euler = 0.5772156649015329
    assert op.digamma(np.array([1.0, 2.0, 0.5])) == pytest.approx([-euler, 1 - euler, -euler - 2 * math.log(2)], abs=1e-9)
    assert op.trigamma(np.array([1.0, 2.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 6 - 1, math.pi**2 / 2], abs=1e-9)


def plain_infer(bag, words, prior):
    """One text, one entry at a time."""
    if not bag:
        return prior
    shares = np.ones(len(prior))
    for _ in range(op.STEPS):
        topic = op.expected(shares)
        new = prior.copy()
        for term, count in bag:
            mixed = topic * words[term]
            new = new + count * mixed / mixed.sum()
        change, shares = np.abs(new - shares).mean(), new
        if change <= op.SETTLED:
            break
    return shares


def test_texts_are_inferred_as_if_alone():
    random = np.random.default_rng(3)
    words, prior = op.expected(random.gamma(1, 1, (3, 40))).T.copy(), np.array([0.2, 0.5, 0.1])
    bags = [[(int(t), int(random.integers(1, 9))) for t in sorted(random.choice(40, n, replace=False))] for n in random.integers(0, 15, 60)]
    lengths = np.array([len(b) for b in bags])
    found = op.infer(lengths, np.array([t for b in bags for t, _ in b]), np.array([c for b in bags for _, c in b], dtype=float), words, prior)
    for bag, row in zip(bags, found, strict=True):
        assert row == pytest.approx(plain_infer(bag, words, prior), rel=1e-9)


def planted(spark, texts=400):
    """Texts of two of four groups of ten words, three words to one."""
    random = np.random.default_rng(7)
    rows = []
    for i in range(texts):
        main, other = random.choice(4, 2, replace=False)
        rows.append((i, [f"w{main}{chr(97 + w)}" for w in random.integers(0, 10, 30)] + [f"w{other}{chr(97 + w)}" for w in random.integers(0, 10, 10)], int(main)))
    return spark.createDataFrame(rows, "text_id int, tokens array<string>, main int")


@pytest.fixture(scope="module")
def fitted(spark):
    texts = planted(spark)
    vocab = corpus.vocabulary(texts, 1, 1.0, 100)
    vectors = topics.term_vectors(texts, vocab)
    return vectors, vocab, topics.train_topics(vectors, 4, passes=8, chunk_size=50)


def test_planted_topics_are_recovered(fitted):
    vectors, vocab, model = fitted
    words = topics.topic_words(model, vocab, 10).collect()
    groups = {t: {r.word[:2] for r in words if r.topic_id == t} for t in range(4)}
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == 4
    best = topics.document_topics(model, vectors, ["text_id", "main"]).groupBy("text_id", "main").agg(F.max_by("topic_id", "prob").alias("t")).collect()
    assert sum(groups[r.t] == {f"w{r.main}"} for r in best) > 0.97 * len(best)


def test_a_new_run_gives_the_same_model(fitted):
    vectors, _, model = fitted
    again = topics.train_topics(vectors, 4, passes=8, chunk_size=50)
    assert again.weights == pytest.approx(model.weights, rel=1e-6) and again.prior == pytest.approx(model.prior, rel=1e-6)


def test_an_update_reads_its_chunk_only(spark, fitted, monkeypatch):
    vectors, _, _ = fitted
    read, inner = [], op._statistics

    def statistics(spark, path, *rest):
        read.append(spark.read.parquet(path).count())
        return inner(spark, path, *rest)

    monkeypatch.setattr(op, "_statistics", statistics)
    topics.train_topics(vectors, 2, passes=3, chunk_size=100)
    assert sum(read) == 3 * 400 and len(read) == 12
    read.clear()
    topics.train_topics(vectors, 2, passes=2, online=False)
    assert read == [400, 400]


def test_newton_step_finds_the_prior_of_planted_shares():
    random = np.random.default_rng(1)
    true = np.array([0.3, 1.2, 4.0])
    mean_log = np.log(random.dirichlet(true, 50_000)).mean(axis=0)
    prior = np.ones(3)
    for _ in range(60):
        prior = op.learned_prior(prior, mean_log, 50_000, 0.5)
    assert prior == pytest.approx(true, rel=0.05)


def test_bags_and_awkward_rows(spark):
    rows = [(1, ["b", "a", "b", "zz", None]), (2, []), (3, None), (4, ["zz"]), (5, ["a"] * 70_000)]
    texts = spark.createDataFrame(rows, "text_id int, tokens array<string>")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id int")
    vectors = topics.term_vectors(texts, vocab)
    got = {r.text_id: [tuple(e) for e in r.bag] for r in vectors.collect()}
    assert got == {1: [(0, 1), (1, 2)], 2: [], 3: [], 4: [], 5: [(0, 70_000)]}
    model = topics.train_topics(vectors, 2, passes=1, chunk_size=2, num_terms=3)
    assert model.num_terms == 3
    sums = topics.document_topics(model, vectors, min_probability=0.0).groupBy("text_id").agg(F.sum("prob").alias("s")).collect()
    assert len(sums) == 5 and all(r.s == pytest.approx(1) for r in sums)
    assert topics.document_topics(model, vectors.limit(0)).count() == 0
    with pytest.raises(ValueError):
        topics.train_topics(vectors.limit(0), 2)


def test_a_vocabulary_without_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(topics, "MAX_TERMS", 2)
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id int")
    with pytest.raises(ValueError):
        topics.vocabulary_terms(vocab)


@pytest.mark.parametrize("parts", [1, 7, 100])
def test_parts_give_the_same_weights(spark, fitted, parts):
    _, vocab, model = fitted
    bodies = [f"w{i % 4}{chr(97 + i % 10)}, w{i % 3}a. Can't w0b..." for i in range(100)]
    schema = "post_id string, subreddit string, post_title string, comments_bodies array<string>"
    whole = spark.createDataFrame([("p", "s", "W0a w1b", bodies), ("q", "t", None, None)], schema)
    step = -(-100 // parts)
    rows = [("p", "s", "W0a w1b", bodies[k * step : (k + 1) * step], k) for k in range(parts)] + [("q", "t", None, None, 0)]
    cut = spark.createDataFrame(rows, schema + ", part int")
    weights = lambda posts: {(r.post_id, r.topic_id): r.prob for r in topics.document_topics(model, topics.community_vectors(posts, vocab), ["post_id"], 0.0).collect()}
    got, want = weights(cut), weights(whole)
    assert got.keys() == want.keys() and len(got) == 8
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_chunk_is_work_for_several_tasks(spark, monkeypatch):
    import os

    from threadlens.operators import topic_model

    seen, whole = [], topic_model._statistics

    def counted(spark, path, *rest):
        files = [f for f in spark.read.parquet(path).inputFiles() if os.path.basename(f).startswith("part-")]
        seen.append((len(files), spark.read.parquet(path).count()))
        return whole(spark, path, *rest)

    monkeypatch.setattr(topic_model, "_statistics", counted)
    vectors = spark.range(9_000).selectExpr("array(named_struct('term_id', cast(id % 7 as int), 'cnt', 1L)) AS bag")
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # would put so few bytes into one task
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        topic_model.train(vectors, 2, 1, 9_000, num_terms=7)
    finally:
        spark.conf.set(merging, before)
    assert len(seen) == 1 and seen[0][0] > 1 and seen[0][1] == 9_000
