import pytest

from threadlens.operators import sentiment as op

#: Valences of the published lexicon, from memory; that of "uncompelling" is what its example's published score asks for.
LEXICON = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "horrible": -2.5, "great": 3.1, "bad": -2.5, "sux": -1.5, "no": -1.2, "friend": 2.2, "kind": 2.4, "uncompelling": -0.9}

#: Published examples, and the rules one by one.
EXAMPLES = [
    ("VADER is smart, handsome, and funny.", 0.8316),
    ("VADER is smart, handsome, and funny!", 0.8439),
    ("VADER is very smart, handsome, and funny.", 0.8545),
    ("VADER is VERY SMART, handsome, and FUNNY.", 0.9227),
    ("VADER is VERY SMART, handsome, and FUNNY!!!", 0.9342),
    ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", 0.9469),
    ("VADER is not smart, handsome, nor funny.", -0.7424),
    ("The book was good.", 0.4404),
    ("At least it isn't a horrible book.", 0.431),
    ("The book was only kind of good.", 0.3832),
    ("The plot was good, but the characters are uncompelling and the dialog is not great.", -0.7042),
    ("Today SUX!", -0.5461),
    ("Not bad at all", 0.431),
]


@pytest.fixture(scope="module")
def score(spark):
    lexicon = spark.createDataFrame(list(LEXICON.items()), "word string, valence double")

    def run(texts):
        df = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
        return {r.text_id: (r.compound, r.sentiment) for r in op.sentiment_in_context(df, lexicon).collect()}

    return run


def test_published_examples(score):
    found = score([t for t, _ in EXAMPLES])
    assert {t: round(found[i][0], 4) for i, (t, _) in enumerate(EXAMPLES)} == dict(EXAMPLES)


def compound(total):
    return pytest.approx(total / (total * total + 15) ** 0.5)


def test_rules_one_by_one(score):
    found = score(
        [
            "never so good",
            "without a doubt good",
            "no good",
            "no bad nor good",
            "the least good",
            "at least good",
            "kind of a thing",
            "good???",
            "bad ?????",
            "a good friend",
        ]
    )
    assert found[0][0] == compound((1.9 + 0.293) * 1.25)
    assert found[1][0] == compound(1.9)
    assert found[2][0] == compound(1.9 * -0.74)
    assert found[3][0] == compound(-2.5 * -0.74 + 1.9 * -0.74 * -0.74)
    assert found[4][0] == compound(1.9 * -0.74)
    assert found[5][0] == compound(1.9)
    assert found[6][0] == 0.0 and found[6][1] == "neutral"
    assert found[7][0] == compound(1.9 + 3 * 0.18)
    assert found[8][0] == compound(-2.5 - 0.96)
    assert found[9][0] == compound(1.9 + 2.2)


def test_awkward_texts(spark, score):
    found = score([None, "", " \n ", "!!!", "unknown words only", "good " * 30_000, "GOOD BAD", "(good)"])
    assert [found[i] for i in range(5)] == [(None, "unknown")] * 5
    assert found[5][0] == compound(1.9 * 30_000) and found[5][1] == "positive"
    assert found[6][0] == compound(1.9 - 2.5)  # all in capitals: none is stressed
    assert found[7][0] == compound(1.9)
    assert score([]) == {}


def test_repeated_rows_and_words_of_the_table(spark):
    lexicon = spark.createDataFrame([("Good", 1.0), ("good", 2.0), ("bad", None)], "word string, valence double")
    df = spark.createDataFrame([(1, "good"), (1, "good"), (None, "good")], "text_id int, text string")
    found = {r.text_id: r.compound for r in op.sentiment_in_context(df, lexicon).collect()}
    assert found[1] == compound(2.0)
