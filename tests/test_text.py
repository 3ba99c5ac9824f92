import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadlens.functions import text as tx
from threadlens.operators import corpus

NOISE = r"(?:@|http?://|https?://|www)\S+|[^A-Za-z0-9]+"


def test_cleaning_matches_the_pattern_in_python(spark):
    samples = [
        "Élection très_bien #Two_Words",
        "see http://x.y/z?q=1 and https://a.b now",
        "wwwhat is swww.there at a@mention.com @alone",
        "url http://a b   next",
        "",
        "plain",
        "a\x1cb http://q\x1cz http://q\x0bz",
    ]
    df = spark.createDataFrame([(s,) for s in samples], "text string")
    got = [r[0] for r in df.select(tx.clean_text("text")).collect()]
    assert got == [re.sub(NOISE, " ", s) for s in samples]


def test_tokens(spark):
    df = spark.createDataFrame([("I cannot, GONNA win the fertilità of it",), (None,)], "text string")
    got = corpus.with_tokens(df, ["The", "can"]).collect()
    assert got[0].tokens == ["not", "gon", "win", "fertilit"]
    assert got[1].tokens == []


def test_regex_stopwords_undouble_backslashes(spark):
    df = spark.createDataFrame([("votes voting revote campaign",)], "text string")
    out = corpus.with_tokens(df, [], [r"\\bvot(ing|es)\\b"]).first()
    assert out.tokens == ["revote", "campaign"]
    literal = corpus.with_tokens(df, [r"\\bvot(ing|es)\\b"]).first()
    assert literal.tokens == ["votes", "voting", "revote", "campaign"]


def test_raw_text_tokens(spark):
    df = spark.createDataFrame([("Don't stop (now): it's 3:30, \"ok\"... right? End.",)], "text string")
    got = df.select(tx.raw_text_tokens("text").alias("t")).first().t
    assert got == ["do", "n't", "stop", "now", "it", "s", "3:30", "ok", "right", "end"]


def test_configured_stopwords():
    config = {"it": ["a", "b"], "en": ["c"]}
    assert corpus.configured_stopwords(config, None) is None
    assert corpus.configured_stopwords(config, "en") == ["c"]
    with pytest.warns(UserWarning):
        assert corpus.configured_stopwords(config, ["it", "xx", "en"]) == ["a", "b", "c"]


def test_default_stopwords(spark):
    assert "the" in tx.default_stopwords(spark, "en")
    with pytest.raises(ValueError):
        tx.default_stopwords(spark, "sl")


def greedy(tokens, accepted):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in accepted:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.sampled_from("abc"), max_size=12), min_size=1, max_size=20),
    st.sets(st.tuples(st.sampled_from("abc"), st.sampled_from("abc")), max_size=6),
)
def test_phrases_join_greedily(spark, texts, accepted):
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, tokens array<string>")
    phrases = spark.createDataFrame(sorted(accepted), "a string, b string")
    got = {r.text_id: r.tokens for r in corpus.apply_phrases(df, phrases).collect()}
    assert got == {i: greedy(t, accepted) for i, t in enumerate(texts)}


def test_phrase_scores_are_strict(spark):
    """One pair above, one exactly at and one below the threshold."""
    texts = [["x", "y"]] * 10 + [["p", "q"]] * 6 + [["r"], ["s"]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, tokens array<string>")
    # Keys: x y p q r s x_y p_q = 8. x_y: 5/100*8 = 0.4, p_q: 1/36*8 = 0.2222
    found = {r.phrase: r.score for r in corpus.phrase_scores(df, 5, 0.2).collect()}
    assert found == {"x_y": pytest.approx(0.4), "p_q": pytest.approx(8 / 36)}
    assert {r.phrase for r in corpus.phrase_scores(df, 5, 5 / 100 * 8).collect()} == set()
    assert {r.phrase for r in corpus.phrase_scores(df, 5, 0.3).collect()} == {"x_y"}


def test_two_passes_make_trigrams_and_keep_the_words(spark):
    texts = [["new", "york", "city", f"w{i}"] for i in range(40)] + [[f"o{i}", f"p{i}"] for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, tokens array<string>")
    got = {r.text_id: r.tokens for r in corpus.with_phrases(df, threshold=5.0).collect()}
    assert got[0][0] == "new_york_city"
    assert all("_".join(t) == "_".join(texts[i]) for i, t in got.items())


def test_vocabulary_bounds_and_ties(spark):
    texts = [["a", "b", "b"], ["a", "c"], ["a", "b"], ["d", "c"], []]
    df = spark.createDataFrame(list(enumerate(texts)), "text_id int, tokens array<string>")
    for keep in (10, None):
        got = [(r.term, r.term_id, r.doc_freq) for r in corpus.vocabulary(df, 2, 0.5, keep).orderBy("term_id").collect()]
        assert got == [("b", 0, 2), ("c", 1, 2)]
    vocab = corpus.vocabulary(df, 2, 0.5, 1)
    assert [tuple(r) for r in corpus.bag_of_words(df, vocab).orderBy("text_id").collect()] == [(0, 0, 2), (2, 0, 1)]


def test_posts_and_comments_are_documents(spark):
    posts = spark.createDataFrame(
        [("p", "s", "u", "title text", ["one", None]), ("q", "s", None, "only", None)],
        "post_id string, subreddit string, post_author string, post_title_and_text string, comments_bodies array<string>",
    )
    docs = {r.text_id: r.text for r in corpus.post_and_comment_texts(posts).collect()}
    assert docs == {"p#0": "title text", "p#1": "one", "p#2": None, "q#0": "only"}
    assert corpus.post_and_comment_texts(posts, comment_words_in=False).count() == 2
    texts, vocab, bow = corpus.prepare_corpus(posts, no_below=1, no_above=0.9)
    assert texts.count() == 4 and vocab.count() == 4 and bow.count() == 4


def test_normal_forms(spark):
    df = spark.createDataFrame([(1, ["cats", "cats", "run"]), (2, [])], "text_id int, tokens array<string>")
    mapping = spark.createDataFrame([("en", "cats", "cat"), ("fr", "run", "x")], "lang string, token string, norm string")
    got = {r.text_id: r.tokens for r in corpus.map_tokens(df, mapping, "en").collect()}
    assert got == {1: ["cat", "cat", "run"], 2: []}


def test_language_and_sentiment(spark):
    df = spark.createDataFrame([(1, "the cat and the dog"), (2, "le chat"), (3, "zzz"), (4, "the le")], "text_id int, text string")
    lists = {"en": ["the", "and"], "fr": ["le"]}
    got = {r.text_id: r.detected for r in corpus.with_language(df, lists).collect()}
    assert got == {1: "en", 2: "fr", 3: None, 4: "en"}
    lexicon = spark.createDataFrame([("cat", 2.0), ("chat", -2.0), ("le", 2.0)], "word string, valence double")
    got = {r.text_id: r.sentiment for r in corpus.sentiment_labels(df, lexicon).collect()}
    assert got == {1: "positive", 2: "neutral", 3: "unknown", 4: "positive"}
    assert spark.range(1).select(tx.compound_valence(F.lit(4.0))).first()[0] == pytest.approx(4 / 31**0.5)


def test_normalisation_kinds(spark):
    df = spark.createDataFrame([(1, ["cats"])], "text_id int, tokens array<string>")
    mapping = spark.createDataFrame([("en", "cats", "cat")], "lang string, token string, norm string")
    assert corpus.normalize_tokens(df, "stemming", mapping).first().tokens == ["cat"]
    assert corpus.normalize_tokens(df, None, mapping).first().tokens == ["cats"]
    with pytest.warns(UserWarning):
        assert corpus.normalize_tokens(df, "lemmining", mapping).first().tokens == ["cats"]
    with pytest.raises(ValueError):
        corpus.normalize_tokens(df, "lemmatization", None)


def test_all_stopwords(spark):
    words = corpus.all_stopwords(spark, "en", {"x": ["EU ", "The"]}, "x")
    assert "eu" in words and "the" in words and words == sorted(set(words))
    assert corpus.all_stopwords(spark, "sl", base=["in"]) == ["in"]


def test_long_texts_are_mapped_without_a_look_up_in_a_list(spark):
    from pyspark.sql import functions as F

    many = [f"w{i}" for i in range(20_000)]
    df = spark.createDataFrame([(1, many + many[:3]), (2, []), (3, None), (1, ["w1", None])], "text_id int, tokens array<string>")
    mapping = spark.range(20_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("token"), F.concat(F.lit("n"), "id").alias("norm"))
    found = corpus.map_tokens(df, mapping, "en")
    assert "map_from_entries" not in found._jdf.queryExecution().toString()
    got = sorted((r.text_id, r.tokens) for r in found.where("size(tokens) > 0").collect())
    assert got == [(1, [t.replace("w", "n") for t in many + many[:3]]), (1, ["n1", None])]
    assert sorted((r.text_id, r.tokens) for r in found.where("text_id > 1").collect()) == [(2, []), (3, None)]


def test_cleaning_of_texts_with_and_without_addresses(spark):
    from pyspark.sql import functions as F

    from threadlens.functions import text as tx

    texts = ["plain, text", "see www.a-b.c x", "a htt://b.c d", "http: //x", "é@me_you z", "ftp://q.r s", "", None, "WWW.a b", "http://a b"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert all(r.a == r.b for r in df.select(tx.clean_text("text").alias("a"), F.regexp_replace("text", tx.NOISE, " ").alias("b")).collect())


def test_cleaning_uses_no_negated_ranges(spark):
    """Java takes over ten times as long for [^A-Za-z0-9]+ as for the named class, which means the same."""
    from pyspark.sql import functions as F

    from threadlens.functions import text as tx

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x11000), 0x1F600, 0x10FFFF]))
    df = spark.createDataFrame([("aé1_" + every + "Z",), ("www.x y " + every,), ("  ",)], "text string")
    assert "[^A-Za-z0-9]" not in df.select(tx.clean_text("text"))._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.a == r.b for r in df.select(tx.clean_text("text").alias("a"), F.regexp_replace("text", tx.NOISE, " ").alias("b")).collect())


def test_matches_are_chosen_without_a_window(spark):
    tokens = ["a", "b", "a", "b", "x", "a", "b", "a"] * 700
    df = spark.createDataFrame([(1, tokens), (2, ["x"]), (3, []), (4, None)], "text_id int, tokens array<string>")
    phrases = spark.createDataFrame([("a", "b"), ("b", "a")], "a string, b string")
    found = corpus.apply_phrases(df, phrases)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.text_id: r.tokens for r in found.collect()} == {1: greedy(tokens, {("a", "b"), ("b", "a")}), 2: ["x"], 3: [], 4: None}


def test_packed_counts_are_those_of_all_tokens_and_pairs(spark, monkeypatch):
    """Many slices and buckets; texts that join to one form, null and empty tokens."""
    import random
    from collections import Counter

    from threadlens.operators import gram_table as g

    draw = random.Random(5)
    texts = [[draw.choice(["a", "b", "c_d", "d", "a_b", "", "é" * 20]) for _ in range(draw.randrange(30))] for _ in range(150)] + [None, []]
    keys, pairs = Counter(), set()
    for text in texts:
        keys.update(text or [])
        joined = list(zip((text or [])[:-1], (text or [])[1:], strict=True))
        keys.update(f"{a}_{b}" for a, b in joined)
        pairs.update(joined)
    expected = {(t, None): keys[t] for text in texts for t in text or []} | {(a, b): keys[f"{a}_{b}"] for a, b in pairs if keys[f"{a}_{b}"] > 9}
    keys.update(["a", "b"])
    expected[("a", None)], expected[("b", None)] = keys["a"], keys["b"]
    frame = spark.createDataFrame(list(enumerate([*texts, ["a", None, "b"]])), "text_id int, tokens array<string>")
    monkeypatch.setattr(g, "BUCKET_TOKENS", 100)
    slices = corpus.snapshot(g.pack(frame))
    found = [tuple(r) for r in g.gram_table(slices, 9).collect()]
    assert len([r for r in found if r[0] is None]) > 10
    assert {(a, b): n for a, b, n in found if a is not None} == expected and sum(n for a, _, n in found if a is None) == len(keys)
    assert sorted(map(tuple, g.unpack(slices, frame.schema).collect())) == list(enumerate([*texts, ["a", None, "b"]]))


def test_slices_are_bounded_and_keep_the_rows(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    from threadlens.operators import gram_table as g

    texts = [[f"w{i % 7}"] * (i % 11) for i in range(300)] + [None, ["x"] * 500, [None, "é"], []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.list_(pa.string()))], names=["text_id", "tokens"])
    monkeypatch.setattr(g, "SLICE_BYTES", 2_000)
    monkeypatch.setattr(g, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rows = pa.Table.from_batches(g._packed([batch.slice(0, 50), batch.slice(50)]))
    assert rows["slice"].to_pylist() == [(3 << 33) + i for i in range(rows.num_rows)] and rows.num_rows > 10
    assert sorted(rows["tokens"].to_pylist())[-2] <= 2_000 // g.TOKEN_BYTES and sum(rows["tokens"].to_pylist()) == sum(len(t or []) for t in texts)
    held = [g._open(x) for x in rows["packed"]]
    assert [r for t in held for r in zip(t["text_id"].to_pylist(), t["tokens"].to_pylist(), strict=True)] == list(enumerate(texts))


def test_phrases_leave_one_table_and_no_shuffle_files(spark):
    """The disk held every count, pair and shuffle of both passes until the driver collected its garbage."""
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/threadlens"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def there():
        files = disk.getAllFiles()
        shuffled = {name for name in (files.apply(i).getName() for i in range(files.length())) if name.startswith("shuffle_")}
        return shuffled, set(os.listdir(shared)) if os.path.isdir(shared) else set()

    texts = [["new", "york", "city", f"w{i}"] for i in range(40)] + [[f"o{i}", f"p{i}"] for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(texts)), "text_id int, tokens array<string>").repartition(3, "text_id")
    shuffled, tables = there()
    made = corpus.with_phrases(frame, threshold=5.0)
    after, left = there()
    assert not after - shuffled and [name.split("-")[0] for name in left - tables] == ["trigrams"]
    assert made.filter("tokens[0] = 'new_york_city'").count() == 40
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_phrases_of_no_texts_and_of_rows_with_other_columns(spark):
    import datetime

    kind = "id string, at timestamp, more struct<x:int,y:array<string>>, tokens array<string>, n bigint"
    assert corpus.with_phrases(spark.createDataFrame([], kind), key="id").count() == 0
    when = datetime.datetime(2020, 5, 1, 12, 30)
    rows = [(f"k{i}", when, (i, ["p"]), ["new", "york", f"w{i}"], i) for i in range(30)] + [("none", None, None, None, None)]
    frame = spark.createDataFrame(rows, kind)
    phrases = spark.createDataFrame([("new", "york"), (None, "x")], "a string, b string")
    whole = {r.id: r for r in corpus.apply_phrases(frame, phrases, "id").collect()}
    assert {k: tuple(r) for k, r in whole.items()} == {r[0]: (*r[:3], r[3] and ["new_york", r[3][2]], r[4]) for r in rows}
    assert corpus.apply_phrases(frame, phrases, "id").schema.simpleString() == frame.schema.simpleString()
    made = {r.id: r.tokens for r in corpus.with_phrases(frame, threshold=0.5, key="id").collect()}
    assert made["k3"] == ["new_york", "w3"] and made["none"] is None
