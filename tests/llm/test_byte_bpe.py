import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import byte_bpe as op

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return op.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), RANKS)


@pytest.fixture(scope="module")
def exact():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(vocabulary):
    return op.Encoder(vocabulary)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab CsT'1² \n\t\r\x0b\x1c\x85\xa0.!é漢😀ñ_<|>"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_same_ids_as_the_ranks(encoder, exact, texts):
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode_ordinary(text)


def test_a_full_store_changes_nothing(vocabulary, exact, monkeypatch):
    monkeypatch.setattr(op, "STORE", 3)
    small = op.Encoder(vocabulary)
    for text in ("one two three four five six", "six one <|endoftext|> seven  eight", "one two"):
        assert np.frombuffer(small.encode([text])[0], "<u4").tolist() == exact.encode_ordinary(text)


def test_round_trip_offsets_and_digests(spark, awkward, vocabulary, exact):
    texts = {i: r.text or "" for i, r in enumerate(awkward.collect())}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = {r.doc_id: r for r in op.encode(docs, vocabulary).collect()}
    for i, text in texts.items():
        ids = exact.encode_ordinary(text)
        assert rows[i].ids == ids
        if len(text) < 1000:
            for token, start, end in zip(ids, rows[i].starts, rows[i].ends, strict=True):
                assert vocabulary.table[token] in text[start:end].encode()
    back = {r.doc_id: r.text for r in op.decode(op.encode(docs, vocabulary), vocabulary).collect()}
    assert back == texts
    for r in op.digests(docs, vocabulary).collect():
        ids = np.array(exact.encode_ordinary(texts[r.doc_id]), dtype="<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_split_characters_and_no_rows(spark, vocabulary, encoder, make_docs):
    ids = np.frombuffer(encoder.encode(["😀"])[0], "<u4")
    assert len(ids) > 1 and op.decode_bytes(ids[:1], vocabulary.table) == "😀".encode()[: len(vocabulary.table[ids[0]])]
    cut = spark.createDataFrame([(1, [int(ids[0])]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in op.decode(cut, vocabulary).collect()} == {1: "�", 2: None, 3: ""}
    assert op.digests(make_docs([]), vocabulary).count() == 0


def test_files_must_agree(tmp_path):
    other = tmp_path / "x.tiktoken"
    other.write_bytes(base64.b64encode(b"a") + b" 5\n")
    with pytest.raises(ValueError):
        op.load_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), str(other))


def test_units_go_to_the_library_together(vocabulary, exact):
    encoder, calls = op.Encoder(vocabulary), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, **more):
            calls.extend(texts)
            return self.library.encode_batch_fast(texts, **more)

        def encode(self, text, **more):
            return self.library.encode(text, **more)

    encoder.library = Counted(encoder.library)
    texts = [" ".join(f"w{i}é'{i * 7}\n漢{i}!" for i in range(2_000)), "it 's \x1cx\x85 we  y'all\n", "a\n b"]
    got = encoder.encode(texts[:2])
    assert [np.frombuffer(ids, "<u4").tolist() for ids in got] == [exact.encode_ordinary(text) for text in texts[:2]]
    assert len(calls) < 30
