import pytest

#: Columns that clash with results or helpers of the operators.
EXTRA = "kept boolean, score double, fp long, bin string, rank int, slot long, count long, _text string, _lang string, spans string, word string"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text, lang, source) rows, with clashing extra columns."""

    def make(rows):
        extra = (False, 0.5, 7, "b", 1, 2, 3, "t", "g", "s", "w")
        return spark.createDataFrame([(d, t, g, s, len(t or ""), *extra) for d, t, g, s in rows], DOCUMENTS)

    return make


@pytest.fixture
def awkward(make_docs):
    """Nulls in every column, empty, blank and very long texts, repeated rows and keys."""
    prose = "the cat and the dog sat on a mat with the hat of it. " * 5
    long = " ".join(f"word{i} the of" for i in range(60_000))
    return make_docs(
        [
            (1, None, "en", "s1"),
            (2, "", "en", "s1"),
            (3, " \n\t ", None, None),
            (4, prose, "en", "s1"),
            (5, prose, "en", "s1"),
            (5, prose, "en", "s1"),
            (6, long, "en", None),
            (None, prose + "x", None, "s2"),
            (None, None, None, None),
            (7, "der Hund und die Katze sind auf dem Tisch mit der Maus und das ist gut für sie", "de", "s1"),
            (8, "naïve 漢字 😀 password=abcdefgh99", "en", "s1"),
        ]
    )
