import numpy as np
import pytest

from threadlens.operators import selection
from threadlens.operators import term_index as op


def test_equals_the_search_term_by_term(spark, rows):
    texts = ["The cat sat", "a cart of OATS", "catcat", "", None, "naïve 漢字 😀 x", "ab", "line\nbreak cat", "x" * 50_000 + " needle"]
    df = spark.createDataFrame([(i, t, texts[-1 - i]) for i, t in enumerate(texts)], "id int, title string, body string")
    listed = {"en": ["cat", "CAT", "at s", "oats", "a", "", "ab", "needle", "k\nbr", "zzz"], "fr": ["cat", "漢字", "字 😀", "ï"]}
    table = spark.createDataFrame([(g, t, i, j) for i, (g, some) in enumerate(listed.items()) for j, t in enumerate(some)], "lang string, term string, lang_rank int, term_rank int")
    want = selection.search_terms(df, listed, ["title", "body"])
    got = op.search_term_table(df, table, ["title", "body"], "id")
    assert rows(got, *want.columns) == rows(want) and got.count() > 30


def test_ten_thousand_terms(spark):
    random = np.random.default_rng(4)
    word = lambda n: "".join(random.choice(list("abcde"), n))
    texts = [" ".join(word(random.integers(1, 9)) for _ in range(60)) for _ in range(120)]
    terms = sorted({word(random.integers(1, 11)) for _ in range(22_000)})[:10_000]
    assert len(terms) > 9_000
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = op.search_term_table(df, spark.createDataFrame([(t,) for t in terms], "term string"), ["text"], "id")
    assert sorted((r.id, r.term) for r in got.select("id", "term").collect()) == [(i, t) for i, text in enumerate(texts) for t in terms if t in text]


def test_a_rare_gram_brings_few_candidates(spark):
    df = spark.createDataFrame([(i, "the common words " + ("zyx" if i == 7 else "")) for i in range(50)], "id int, text string")
    terms = spark.createDataFrame([("words zyx",), ("the thex",)], "term string")
    from pyspark.sql import functions as F

    waiting, _ = op.waiting_terms(df, terms.select(F.col("term").alias("needle")), [F.lower(F.col("text"))])
    # the second has a gram that no text has
    met = waiting.collect()
    assert [r.needle for r in met] == ["words zyx"] and "z" in met[0].gram


def test_no_terms_and_clashes(spark):
    df = spark.createDataFrame([(1, "a")], "id int, text string")
    terms = spark.createDataFrame([(None,)], "term string")
    assert op.search_term_table(df, terms, ["text"], "id").count() == 0
    assert op.search_term_table(df.limit(0), spark.createDataFrame([("a",)], "term string"), ["text"], "id").count() == 0
    with pytest.raises(ValueError):
        op.search_term_table(df, terms.selectExpr("term", "term AS text"), ["text"], "id")


def test_a_term_without_a_space_is_sought_once_a_word(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(op, "WORDS", 3)  # so that words are dealt to slices
    seen = []
    meeting = op._meeting
    monkeypatch.setattr(op, "_meeting", lambda rows, needles, lowered, key: (seen.append((key, needles.count())), meeting(rows, needles, lowered, key))[1])
    texts = ["one two three one", "TWO " * 50, "x" * 40 + "needle", "one one", "thr ee two  one four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    listed = ["one", "o", "", "needle", "xne", "wo t", "e", "r", "x" * 41, "ee two"]
    got = op.search_term_table(df, spark.createDataFrame([(t,) for t in listed], "term string"), ["text"], "id")
    assert sorted((r.id, r.term) for r in got.select("id", "term").collect()) == sorted((i, t) for i, text in enumerate(texts) for t in listed if t in text.lower())
    # only terms with a space go to the texts
    assert ("id", 2) in seen and {key for key, _ in seen} == {"id", "_word"}


def test_rows_of_one_key_find_their_own_terms(spark):
    df = spark.createDataFrame([(1, "cat"), (1, "dog"), (None, "cat")], "id int, text string")
    got = op.search_term_table(df, spark.createDataFrame([("at",), ("do",), ("c d",)], "term string"), ["text"], "id")
    assert sorted((r.text, r.term) for r in got.collect()) == [("cat", "at"), ("dog", "do")]
