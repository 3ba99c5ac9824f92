import random
from collections import defaultdict

from threadlens.llm import bestfit_packing as op


def plain_best_fit(items, capacity):
    bins = []
    for size, source, cluster in items:
        fits = [i for i, b in enumerate(bins) if b[0] >= size and (source is None or source not in b[1]) and (cluster is None or cluster not in b[2])]
        i = min(fits, key=lambda i: (bins[i][0], i)) if fits else len(bins)
        if i == len(bins):
            bins.append([capacity, set(), set()])
        bins[i][0] -= size
        bins[i][1].add(source)
        bins[i][2].add(cluster)
        yield i


def test_best_fit_equals_plain_search():
    rng = random.Random(2)
    items = sorted(((rng.randint(1, 50), rng.choice(["a", "a", "b", "c", None]), rng.choice([1, 2, 3, None, None])) for _ in range(400)), key=lambda x: -x[0])
    bins, free = op.best_fit(*map(list, zip(*items, strict=True)), capacity=60)
    assert bins == list(plain_best_fit(items, 60)) and min(free) >= 0


def check(rows, docs, capacity):
    bins, covered = defaultdict(list), defaultdict(int)
    for r in rows:
        bins[r.bin].append(r)
        covered[r.doc_id] += r.size
    for held in bins.values():
        assert sum(r.size for r in held) + held[0].residual == capacity and held[0].residual >= 0
        assert sorted(r.place for r in held) == list(range(len(held)))
        for name in ("source", "cluster"):
            values = [getattr(r, name) for r in held if getattr(r, name) is not None]
            assert len(values) == len(set(values))
    want = defaultdict(int)
    for d in docs:
        want[d.doc_id] += len((d.text or "").encode()) + 1
    assert covered == want
    return bins


def test_all_rows_are_packed_without_conflicts(spark, make_docs):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 900) + str(i) for i in range(120)] + ["Same Text"] * 40 + ["same  text"] * 5 + ["long " * 700]
    docs = make_docs([(i, t, "en", rng.choice(["hot", "hot", "b", "c", "d"])) for i, t in enumerate(texts)])
    for group_rows in (25, 4000):
        check(op.pack(docs, capacity=1000, group_rows=group_rows).collect(), docs.collect(), 1000)


def test_awkward_rows_and_no_rows(spark, awkward, make_docs):
    check(op.pack(awkward).collect(), awkward.collect(), op.CAPACITY)
    assert op.pack(make_docs([])).count() == 0
    text_keys = awkward.selectExpr("cast(doc_id as string) doc_id", "text", "source")
    assert op.pack(text_keys).schema["doc_id"].dataType.simpleString() == "string"


def test_given_sizes_and_clusters(spark, rows):
    docs = spark.createDataFrame([(1, 0, 9, "a"), (2, 5, 9, "b"), (3, None, None, None)], "doc_id long, n long, c long, source string")
    from pyspark.sql import functions as F

    got = op.pack(docs.withColumn("text", F.lit("unused")), capacity=10, size=F.col("n"), cluster=F.col("c"))
    packed = {r.doc_id: r for r in got.collect()}
    assert [packed[i].size for i in (1, 2, 3)] == [1, 5, 1] and packed[1].bin != packed[2].bin
