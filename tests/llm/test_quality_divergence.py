import re

import numpy as np

from threadlens.llm import quality_divergence as op


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    lines, seen, repeats = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeats += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def check(docs, got):
    found = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got))
    assert found == sorted(plain(d.text or "") for d in docs)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_counts_of_awkward_rows(spark, awkward, make_docs):
    docs = [d for d in awkward.collect() if len(d.text or "") < 10_000]
    got = [r for r in op.quality(awkward).collect() if r.n_words < 10_000]
    check(docs, got)
    assert op.quality(awkward).count() == awkward.count() and op.quality(make_docs([])).count() == 0


def test_counts_of_given_documents(spark):
    from threadlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    check(spark.read.parquet(f"{folder}/documents.parquet").collect(), QUERIES["op10_quality_divergence"](spark, folder).collect())


def test_junk_goes_and_clean_text_stays(spark):
    from threadlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_quality_divergence"](spark, folder).collect() if r.doc_id in labels and not r.base_failed]
    clean, junk = ([r for r in got if labels[r.doc_id] == q] for q in (1, 0))
    assert sum(r.kept for r in clean) >= 0.99 * len(clean) and sum(r.kept for r in junk) <= 0.2 * len(junk)


def test_distance():
    p, q = np.array([[1.0, 0, 0], [2, 2, 0], [0, 0, 0]]), np.array([0, 3.0, 0])
    m = np.array([0.25, 0.75])
    want = np.sqrt((0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1]) + np.log2(1 / m[1])) / 2)
    assert np.allclose(op.jensen_shannon(p, q), [1, want, 0])


def test_references_and_unknown_languages(spark, make_docs):
    prose = "the cat and the dog sat on the mat and looked at the moon for a while as it was " * 4
    text = " ".join(f"{w}{i}" if i % 3 == 0 else w for i, w in enumerate(prose.split()))
    docs = make_docs([(i, text + f" {i}", "en", "s") for i in range(5)] + [(9, text, None, "s"), (10, " ".join("X$%9|" + str(i) for i in range(80)), None, "s")])
    kept = {r.doc_id: r.kept for r in op.quality(docs).collect()}
    assert kept == {0: True, 1: True, 2: True, 3: True, 4: True, 9: True, 10: False}
    good = op.keep_good(docs)
    assert sorted(r.doc_id for r in good.collect()) == [0, 1, 2, 3, 4, 9] and good.columns == docs.columns
    unreferenced = op.quality(docs, references=op.References({}, {})).collect()
    assert all(r.kept for r in unreferenced)


def test_clean_documents_of_rare_languages_stay(spark, make_docs):
    # one Greek document beside 2,000 times its words in English
    english = " ".join(f"the cat{i} and the dog{i} sat on the mat" for i in range(60))
    greek = " ".join(f"η γάτα{c} και{c} ο σκύλος κάθονται μαζί στο χαλί" for c in "αβγδεζηθικ")
    docs = make_docs([(i, english, "en", "s") for i in range(400)] + [(1000, greek, "el", "s")])
    assert [r.kept for r in op.quality(docs).collect() if r.doc_id == 1000] == [True]
    assert 1000 in {r.doc_id for r in op.keep_good(docs).collect()}
    # a stated language without a reference is not judged by another language's
    only_english = op.load_references(op.language_references(docs.where("lang = 'en'")))
    assert [r.kept for r in op.quality(docs, references=only_english).collect() if r.doc_id == 1000] == [True]
