import collections
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from threadlens.llm import logbilinear_lm as op
from threadlens.llm.common import remainder


def plain_tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["<end>"]


def check(docs, got, held):
    counts = collections.Counter()
    for d in docs:
        if not held(d):
            counts.update(plain_tokens(d.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d in docs:
        tokens = plain_tokens(d.text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        want.append((str(d.doc_id), held(d), len(tokens), sum(counts[t] > 0 for t in tokens), n, round(base, 5)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got) or not n


def test_base_scores_of_awkward_rows(spark, awkward):
    held = lambda d: zlib.crc32(("" if d.doc_id is None else str(d.doc_id)).encode()) % 7 == 2
    got = op.score(awkward, remainder("doc_id", 7) == 2, classes=8).collect()
    check(awkward.collect(), got, held)


def test_small_slices_and_nothing_to_learn(spark, awkward, make_docs, monkeypatch):
    monkeypatch.setattr(op, "SLICE_CHARS", 50)
    check(awkward.collect(), op.score(awkward, F.lit(False), classes=4).collect(), lambda d: False)
    got = op.score(awkward, F.lit(True)).collect()
    assert {r.train_tokens for r in got} == {0} and all(r.base_score == 0 for r in got)
    assert op.score(make_docs([]), F.lit(False)).count() == 0


def test_scores_are_normalised():
    random = np.random.default_rng(1)
    model = op.fit(random.integers(0, 6, (500, 3)), 6)
    near, far, total = model.scores()
    p = np.exp(near[:, None, :] + far[None, :, :] - total[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4)


def test_noise_contrast_learns_the_chain():
    random = np.random.default_rng(2)
    ids = [0, 1]
    for _ in range(60_000):
        ids.append((ids[-1] + 1) % 5 if random.random() < 0.8 else int(random.integers(0, 5)))
    ids = np.array(ids)
    model = op.fit(np.stack([ids[:-2], ids[1:-1], ids[2:]], axis=1), 5, epochs=4)
    near, far, total = model.scores()
    p = np.exp(near[:, None, :] + far[None, :, :] - total[:, :, None]).mean(axis=1)
    assert all(abs(p[i, (i + 1) % 5] - 0.84) < 0.08 for i in range(5))


def test_model_beats_counts_on_held_out_documents(spark):
    from threadlens.llm.queries import QUERIES

    rows = [r for r in QUERIES["op9_logbilinear_lm"](spark, "/root/testdata/sf0.001").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_training_document_is_learned_from(spark, make_docs):
    random, rows = np.random.default_rng(3), []
    for i in range(300):
        ids = [0]
        for _ in range(1000):
            ids.append((ids[-1] + 1) % 5 if random.random() < 0.9 else int(random.integers(0, 5)))
        rows.append((i, " ".join("abcde"[x] for x in ids), "en", "s"))
    # without a sample all order of words comes from the passes over the documents
    got = op.score(make_docs(rows).coalesce(2), F.lit(False), sample_docs=0).collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


def test_classes_grow_with_the_corpus(spark, awkward, monkeypatch):
    assert op.class_count(10**6) == 512 and 512 < op.class_count(10**8) < op.class_count(10**10)
    docs = lambda: sorted((str(r.doc_id), round(r.score, 2)) for r in op.score(awkward, F.lit(False), classes=40, passes=0).collect())
    by_table = docs()
    monkeypatch.setattr(op, "TABLE_CLASSES", 1)
    assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 0.02 + 1e-4 * abs(a[1]) for a, b in zip(docs(), by_table, strict=True))


def test_sample_holds_class_numbers_beyond_16_bits(spark, make_docs):
    docs = make_docs([(i, "alpha beta", "en", "s") for i in range(3)])
    got = op._sample(docs, F.lit(False), {b"alpha": 40_000, b"beta": 65_535}, "text", "doc_id", 10)
    assert sorted(set(got[:, 2].tolist())) == [0, 40_000, 65_535] and len(got) == 9
