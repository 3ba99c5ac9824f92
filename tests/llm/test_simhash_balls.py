import random
import re

import pytest
import xxhash

from threadlens.llm import simhash_balls as op


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(items, distance=3):
    """Smallest key reachable, by comparing all pairs."""
    parent = {f: f for _, f in items}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = sorted(parent)
    for i, a in enumerate(prints):
        for b in prints[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= distance:
                parent[root(a)] = root(b)
    least = {}
    for key, f in items:
        if key is not None:
            least[root(f)] = min(key, least.get(root(f), key))
    return {f: least.get(root(f)) for _, f in items}


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_every_connection_is_found(spark, distance):
    rng, prints = random.Random(distance), set()
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 20)):
            y = x
            for _ in range(rng.choice([1, 1, 2, 3, 3, 4])):
                y ^= 1 << rng.randrange(64)
            prints.add(y)
            x = y if rng.random() < 0.3 else x
    x, bits = rng.getrandbits(64), rng.sample(range(64), 9)
    for _ in range(120):
        prints.add(x ^ sum(1 << b for b in bits if rng.random() < 0.4))
    items = [(i, op._signed(f)) for i, f in enumerate(sorted(prints))]
    frame = spark.createDataFrame(items, "doc_id long, fp long")
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= distance for r in op.links(frame.select("fp"), distance).collect())
    assert {r.fp: r.component_id for r in op.classes(frame, distance=distance).collect()} == plain_classes(items, distance)


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 900), (900, 700)], "a long, b long")
    got = {r.node: r.root for r in op.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 700: 500, 900: 500}


def test_awkward_rows(spark, awkward, make_docs):
    docs = awkward.collect()
    want = plain_classes([(d.doc_id, plain_fingerprint(d.text or "")) for d in docs])
    got = op.near_duplicates(awkward).collect()
    assert len(got) == len(docs)
    texts = {d.doc_id: d.text or "" for d in docs if d.doc_id is not None}
    for r in got:
        assert r.component_id == want[int(r.fingerprint, 16)]
        if r.doc_id is not None:
            assert r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}"
    kept = op.keep_first(awkward)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for c in want.values() if c is not None})
    assert kept.where("doc_id is null").count() == 2 and kept.columns == awkward.columns
    none = make_docs([])
    assert op.near_duplicates(none).count() == 0 and op.keep_first(none).count() == 0


def test_rows_that_repeat_a_key_stand_for_their_own_texts(spark, make_docs):
    foo, bar, baz = ("alpha beta gamma delta epsilon " * 4, "one two three four five six " * 4, "red green blue white black grey " * 4)
    kept = lambda rows: sorted((r.doc_id, r.text) for r in op.keep_first(make_docs([(i, t, "en", "s") for i, t in rows])).collect())
    assert kept([(3, bar), (5, foo), (5, bar)]) == [(3, bar), (5, foo)]
    assert kept([(5, foo), (5, bar), (5, bar), (6, bar)]) == sorted([(5, foo), (5, bar)])
    assert kept([(3, bar), (3, bar), (5, foo), (5, bar), (4, baz), (5, baz)]) == sorted([(3, bar), (5, foo), (4, baz)])


def test_whole_table_equals_brute_force(spark):
    from threadlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    prints = {d.doc_id: plain_fingerprint(d.text) for d in docs}
    want = plain_classes(list(prints.items()))
    got = QUERIES["op8_simhash_balls"](spark, folder).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", want[f]) for i, f in prints.items()}
