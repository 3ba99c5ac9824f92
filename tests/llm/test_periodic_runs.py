import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import periodic_runs as op
from threadlens.llm.queries import op11_periodic_runs, planted


def brute_lyndon(s):
    """Longest prefix of every suffix that is smaller than all its own suffixes."""
    found = []
    for i in range(len(s)):
        words = [s[i:j] for j in range(i + 1, len(s) + 1)]
        found.append(max(len(u) for u in words if all(u < u[k:] for k in range(1, len(u)))))
    return found


def brute_runs(words, least=12, periods=None):
    n, found = len(words), set()
    for p in periods or range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            stretch = words[start : i + p]
            smaller = not periods and any(all(a == b for a, b in zip(stretch, stretch[q:])) for q in range(1, p))
            if i > start and len(stretch) >= max(least, 2 * p) and not smaller:
                found.add((start, len(stretch), p))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


symbols = st.lists(st.integers(1, 3), max_size=24)
stretches = st.tuples(symbols, st.lists(st.integers(1, 3), min_size=1, max_size=7), st.integers(0, 30), symbols).map(lambda t: t[0] + (t[1] * 30)[: t[2]] + t[3])


@settings(max_examples=300, deadline=None)
@given(st.lists(symbols, min_size=1, max_size=4))
def test_groups_are_lyndon_prefixes_under_both_orders(parts):
    joined = np.array([x for part in parts for x in [0, *part]])
    if joined.any():
        assert op.lyndon_lengths(joined)[joined > 0].tolist() == [x for part in parts for x in brute_lyndon(part)]
        other = np.where(joined > 0, 4 - joined, 0)
        assert op.lyndon_lengths(other)[joined > 0].tolist() == [x for part in parts for x in brute_lyndon([4 - x for x in part])]


@settings(max_examples=300, deadline=None)
@given(st.lists(stretches, max_size=4))
def test_runs_equal_brute_force(texts):
    found = [list(map(tuple, r.tolist())) for r in op.word_runs(texts)]
    assert found == [brute_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(stretches, st.integers(1, 9))
def test_any_least_length(words, least):
    assert list(map(tuple, op.word_runs([words], least)[0].tolist())) == brute_runs(words, least)


def test_nested_runs_drop_each_word_once():
    words = list("aaaaaaaaaaaab") * 3
    runs = op.word_runs([words])[0]
    assert [tuple(r) for r in runs.tolist()] == brute_runs(words)
    dropped = {i for s, n, p in runs.tolist() for i in range(s + p, s + n)}
    assert op.collapse(words, runs) == [w for i, w in enumerate(words) if i not in dropped]


def test_long_periodic_and_nested_words():
    a, b = [1], [1, 2]
    while len(b) < 40_000:
        a, b = b, b + a
    runs = op.word_runs([b, [7] * 50_000, [1, 2, 3] * 20_000])
    assert len(runs[0]) > 1000
    assert runs[1].tolist() == [[0, 50_000, 1]] and runs[2].tolist() == [[0, 60_000, 3]]


def test_query_equals_brute_force(spark, awkward, make_docs, tmp_path):
    more = [(100 + i, " ".join(f"w{(i * k) % 7}" for k in range(40)), "en", "s") for i in range(60)]
    docs = awkward.union(make_docs(more))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for r in docs.collect():
        words = planted((r.text or "").encode().split(), r.doc_id)
        # the very long text has no run but the planted one: all its words but "the of" are different
        g = zlib.crc32(str(r.doc_id).encode()) // 10
        runs = brute_runs(words, periods=[1 + (len(words) - g % len(words)) // (3 + g % 8)]) if len(words) > 5000 else brute_runs(words)
        dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        text = b" ".join(w for i, w in enumerate(words) if i not in dropped)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        exponent = 1000 * best[1] // best[2] if runs else None
        want.append((r.doc_id, len(runs), *best, exponent, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    got = op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[1] for w in want)
    assert op.find(make_docs([])).count() == 0


def test_planted_words_follow_the_rule():
    for key in [*range(300), None]:
        h = zlib.crc32(b"" if key is None else str(key).encode())
        words = [str(i).encode() for i in range(1 + h % 90)]
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        want = [words[a + (i - a) % p] if h % 10 == 0 and i >= a else words[i] for i in range(n)]
        assert planted(words, key) == want
    assert planted([], 0) == []
