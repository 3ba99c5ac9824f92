import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import tree_bpe as op
from threadlens.llm.queries import op12_tree_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "the", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\u2028", "'", "'s", "'re", "'ll", "1", "23", "é", "漢", "😀", "!", "!!!", "==", "aaaa", "abab", "\xa0", "　", "ing", " un", ".", "<|endoftext|>", "<|", "endoftext|>"]


@pytest.fixture(scope="module")
def vocabulary():
    return op.load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return op.TreeEncoder(vocabulary)


def exact(library, text):
    return library.encode(text, add_special_tokens=False).ids


texts = st.lists(st.sampled_from(PIECES), min_size=1, max_size=4).flatmap(lambda some: st.lists(st.sampled_from(some), max_size=120)).map("".join)


@settings(max_examples=400, deadline=None)
@given(texts, st.sampled_from([1, 2, 5, 17, 60, 2000]), st.sampled_from([1, 16, 64]))
def test_joins_equal_the_library(encoder, library, text, leaf, window):
    encoder.leaf, encoder.window = leaf, window
    made = encoder.encode([text])[0]
    whole = library.encode(text, add_special_tokens=False)
    assert made.ids.tolist() == whole.ids
    assert made.first.tolist() == (np.diff(np.array(whole.word_ids, dtype=int), prepend=-1) != 0).tolist()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=80), st.integers(1, 9))
def test_any_characters(encoder, library, text, leaf):
    encoder.leaf, encoder.window = leaf, 8
    assert encoder.encode([text])[0].ids.tolist() == exact(library, text)


@pytest.mark.parametrize("text", ["a" * 60_001, "x" * 9_999 + "y" * 10_001, " " * 50_000 + "end", "!" * 30_000 + "'s" * 10_000, "ab" * 40_000, "qjxzkv" * 9_000], ids=range(6))
def test_long_unsplit_texts(vocabulary, library, text):
    assert op.TreeEncoder(vocabulary).encode([text])[0].ids.tolist() == exact(library, text)


def test_dropped_units_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(op, "STORE", 4)
    small = op.TreeEncoder(vocabulary)
    for text in ("one two\nthree four five\n\n six", "six one <|endoftext|> seven  eight\x1cnine", "one two "):
        assert small.encode([text])[0].ids.tolist() == exact(library, text)


def test_windows_stay_small_where_sides_agree(vocabulary, monkeypatch):
    encoder, read = op.TreeEncoder(vocabulary), []
    inner = encoder._library
    monkeypatch.setattr(encoder, "_library", lambda some: read.append(sum(map(len, some))) or inner(some))
    text = "".join(np.random.default_rng(1).choice(list("abcdefghij"), 200_000))
    encoder.encode([text])
    assert 0 < sum(read) < len(text) / 4


def test_parts_in_rounds_and_awkward_rows(spark, awkward, make_docs, vocabulary, library):
    docs = awkward.union(make_docs([(20, "z" * 3000 + "<|endoftext|>" + "naïve 漢字 " * 400, "en", "s"), (20, "q" * 2600, "en", "s"), (21, "<|endoftext|>", "en", "s")]))
    got = op.encode(docs, vocabulary, part=150, leaf=40)
    want = sorted(((r.doc_id, exact(library, r.text or "")) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got.collect()), key=repr) == want
    back = op.decode(got, vocabulary).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=repr) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert op.encode(make_docs([]), vocabulary).count() == 0


def test_query_digests(spark, awkward, library, tmp_path):
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in awkward.collect():
        ids = exact(library, r.text or "")
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, op12_tree_bpe(spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_decoding_cut_and_unknown_ids(spark, vocabulary, library):
    ids = exact(library, "😀 <|endoftext|>x")
    for some in (ids[:1], ids[1:], ids, [*ids, 2**31], []):
        assert op.decode_ids(np.array(some, dtype="<u4"), vocabulary.table) == library.decode(some, skip_special_tokens=False)
    empty = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert op.decode(empty, vocabulary).first().text is None
    assert op.digests(empty, vocabulary).first().n_tokens == 0


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}])
def test_files_that_cannot_be_joined_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        parts = json.load(file) | change
    (tmp_path / "other.json").write_text(json.dumps(parts))
    with pytest.raises(ValueError):
        op.load_vocabulary(str(tmp_path / "other.json"))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\n\t\r\x1c\x85\xa0\0.!é"), st.characters(codec="utf-8")), max_size=30))
def test_units_are_what_the_cuts_part(text):
    assert op.units(text) == op.CUT.split(text)


def test_plain_texts_are_cut_without_a_look_at_every_place(monkeypatch):
    monkeypatch.setattr(op, "CUT", None)
    assert op.units("one two\nthree  four"[:13]) == ["one", " two", "\n", "three"]


def test_plain_texts_are_told_by_one_set_of_characters():
    """Alternatives made the look through a text several times slower; what it finds stays the same."""
    import itertools
    import re

    plain = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]|\x00")
    for n in range(6):
        for text in map("".join, itertools.product("a \n\t\x00\x1c", repeat=n)):
            assert bool(op.OTHER.search(text)) == bool(plain.search(text))
    assert not op.OTHER.pattern.startswith(r"\s\s|") and op.OTHER.pattern.startswith("[")
