import pytest
from pyspark.sql import functions as F

from threadlens.functions.posts import author_label, author_node_size
from threadlens.operators import corpus, influence, topics
from threadlens.plans import topic_pipeline


@pytest.fixture(scope="module")
def run(spark):
    """Two clear groups of words, and the posts they come from."""
    rows = []
    for i in range(60):
        words = ["apple", "pear", "plum", "grape"] if i % 2 else ["river", "lake", "ocean", "pond"]
        body = " ".join(words[(i + k) % 4] for k in range(4))
        rows.append((f"p{i}", "fruit" if i % 2 else "water", f"u{i % 5}", body, body, [body, "post " + body], ["u1", None]))
    rows.append(("empty", "water", "u9", "zz", "zz", [], []))
    posts = spark.createDataFrame(
        rows,
        "post_id string, subreddit string, post_author string, post_title string, post_title_and_text string, comments_bodies array<string>, comments_author array<string>",
    )
    return posts, topic_pipeline.model_topics(posts, ["post"], num_topics=2, passes=4, num_words=4, no_below=2, no_above=0.9)


def test_topic_words_are_ranked_probabilities(run):
    _, fitted = run
    words = fitted.words.collect()
    assert {r.topic_id for r in words} == {0, 1}
    for t in (0, 1):
        probs = [r.prob for r in sorted((r for r in words if r.topic_id == t), key=lambda r: r["rank"])]
        assert probs == sorted(probs, reverse=True) and sum(probs) <= 1.0 + 1e-9


def test_document_topics_sum_to_one_and_empty_gets_the_prior(run):
    _, fitted = run
    vectors = topics.term_vectors(fitted.texts, fitted.vocab)
    sums = topics.document_topics(fitted.model, vectors, min_probability=0.0).groupBy("text_id").agg(F.sum("prob").alias("s"))
    assert all(r.s == pytest.approx(1.0) for r in sums.collect())
    prior = fitted.model.prior
    empty = topics.document_topics(fitted.model, vectors.filter("text_id = 'empty#0'"), min_probability=0.0)
    assert [r.prob for r in empty.orderBy("topic_id").collect()] == pytest.approx(list(prior / prior.sum()))


def test_community_weights_add_up_to_posts(run):
    posts, fitted = run
    got = {r.subreddit: r.s for r in topic_pipeline.community_weights(fitted, posts).groupBy("subreddit").agg(F.sum("weight").alias("s")).collect()}
    assert got["fruit"] == pytest.approx(30, abs=0.7) and got["water"] == pytest.approx(31, abs=0.7)


def test_graph_counts(run):
    posts, fitted = run
    weights = topic_pipeline.community_weights(fitted, posts)
    nodes, edges = topics.topic_graph(fitted.words, weights, posts, fitted.words)
    assert nodes.count() == 2 + fitted.words.select("word").distinct().count() + 2
    assert edges.filter("weight IS NULL").count() == 8
    ranked = posts.withColumn("row_rank", F.monotonically_increasing_id())
    _, limited = topic_pipeline.topic_community_graph(fitted, ranked, first_communities=1, names=["fruit"])
    assert {r.src for r in limited.filter("weight IS NOT NULL").collect()} == {"water"}
    assert topics.neighbour_lists(edges, per_row=3).agg(F.max(F.size("neighbours"))).first()[0] <= 3


def test_influence(run):
    posts, fitted = run
    found = topic_pipeline.influential_authors(fitted, posts, 0.5, count_mode="kind").collect()
    assert {r.topic_id for r in found} <= {0, 1} and len(found) >= 2
    marker = topic_pipeline.influential_authors(fitted, posts, 1.0)
    assert None in {r.author for r in marker.collect()}
    nodes, edges = influence.author_topic_graph(marker, fitted.words, ["u1"])
    assert edges.filter("dst = 'Author_u1'").count() == 0 and edges.filter("dst = 'Author_None'").count() >= 1
    assert nodes.count() == nodes.select("id").distinct().count()


def test_saving_and_loading(run, spark, tmp_path):
    _, fitted = run
    path = str(tmp_path / "run")
    topics.save_topic_run(path, fitted.model, fitted.texts, fitted.vocab, fitted.bow, {"num_topics": 2})
    model, vocab = topics.load_topic_run(spark, f"{path}/model", f"{path}/vocab")
    assert vocab.count() == fitted.vocab.count()
    assert model.weights == pytest.approx(fitted.model.weights) and model.prior == pytest.approx(fitted.model.prior)
    assert topics.load_topic_run(spark, fitted.model, fitted.vocab) == (fitted.model, fitted.vocab)
    with pytest.raises(ValueError):
        topics.load_topic_run(spark, "a", fitted.vocab)
    overview = topics.term_relevance(
        topics.all_word_weights(fitted.model, fitted.vocab),
        fitted.bow.join(fitted.vocab, "term_id").groupBy(F.col("term").alias("word")).agg(F.sum("cnt").alias("n")),
    )
    assert overview.count() == 2 * fitted.vocab.count()


def test_scores_and_marker_counts(spark):
    words = spark.createDataFrame([(0, "cat", 0.5, 1), (0, "art", 0.2, 2)], "topic_id int, word string, prob double, rank int")
    rows = [
        ("u", 0, 0.4, "a", "a post about a CAT", "comment"),
        ("u", 0, 0.6, "b", "Post comment cart", "post"),
        (None, 0, 0.5, "a", "nothing", "post"),
        ("v", 1, 0.5, "a", "post and comment", "post"),
    ]
    df = spark.createDataFrame(rows, "author string, topic_id int, prob double, subreddit string, text string, kind string")
    got = {(r.author, r.topic_id): r for r in influence.score_authors(influence.author_topic_contributions(df, words)).collect()}
    u = got["u", 0]
    assert (u.posts, u.comments, u.communities, u.keywords) == (1, 1, 2, 2)
    assert u.score == pytest.approx(0.4 * 0.5 + 0.3 * 2 + 0.3 * 2)
    assert got[None, 0].keywords == 0 and got["v", 1].keywords == 0 and got["v", 1].posts == 1
    kinds = {r.author: (r.posts, r.comments) for r in influence.author_topic_contributions(df, words, "kind").collect()}
    assert kinds["u"] == (1, 1)
    with pytest.raises(ValueError):
        influence.author_topic_contributions(df, words, "other")


def test_ties_and_outliers(spark):
    df = spark.createDataFrame([(0, "b", 1.0), (0, "a", 1.0), (0, "c", 0.5), (1, "z", 9.0)] + [(2, f"n{i}", 1.0 + i / 100) for i in range(20)] + [(2, "far", 50.0)], "topic_id int, author string, score double")
    top = influence.dominant_authors(df, 0.34)
    assert [r.author for r in top.filter("topic_id = 0").collect()] == ["a"]
    assert [r.author for r in top.filter("topic_id = 1").collect()] == ["z"]
    flagged = influence.influence_outliers(influence.dominant_authors(df, 1.0))
    assert [r.author for r in flagged.filter("is_outlier").collect()] == ["far"]
    label = df.filter("author = 'far'").select(author_label("author", "score"), author_node_size("score")).first()
    assert tuple(label) == ("far\n(Score: 50.00)", 60.0)


def test_first_rows_win_over_names(spark):
    weights = spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0), ("c", 0, 2.0)], "subreddit string, topic_id int, weight double")
    posts = spark.createDataFrame([("c", 1), ("a", 2), ("c", 3), ("b", 4)], "subreddit string, row_rank int")
    first = topics.first_row_communities(posts, 2)
    pick = lambda **kw: sorted(r.subreddit for r in topics.limit_weights(weights, **kw).collect())
    assert pick(first=first, names=["b"]) == ["a", "c"]
    assert pick(names=["b"]) == ["b"] and pick(top_by_weight=1) == ["b"] and pick() == ["a", "b", "c"]


def test_chunks_are_rows_or_a_share(spark):
    df = corpus.with_tokens(spark.createDataFrame([(i, "alpha beta gamma") for i in range(30)], "text_id int, text string"))
    vocab = corpus.vocabulary(df, 1, 1.0, 10)
    model = topics.train_topics(topics.term_vectors(df, vocab), 2, passes=2, chunk_size=0.5, alpha=0.3, learn_alpha=False)
    assert model.num_terms == 3 and list(model.prior) == [0.3, 0.3]
    with pytest.raises(ValueError):
        topics.train_topics(topics.term_vectors(df.limit(0), vocab), 2)
