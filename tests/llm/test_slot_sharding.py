import zlib
from collections import defaultdict

from threadlens.llm import slot_sharding as op


def check(docs, got, shards):
    sizes = sorted((len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert sorted((r.size, r.text_crc32) for r in got) == sizes
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rows_sizes_and_places(spark, awkward, make_docs):
    check(awkward.collect(), op.shard(awkward).collect(), 40)
    assert op.shard(make_docs([])).count() == 0


def test_sizes_come_near_equal(spark, make_docs):
    docs = make_docs([(i, "y" * (i * 37 % 900), "en", "s") for i in range(2000)])
    got = op.shard(docs, shards=8).collect()
    check(docs.collect(), got, 8)
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.01 * min(loads.values())


def test_equal_rows_fill_no_shard(spark, make_docs):
    docs = make_docs([(7, "same text", "en", "s")] * 2000 + [(None, None, "en", "s")] * 1000 + [(i, "other", "en", "s") for i in range(100, 200)])
    got = op.shard(docs, shards=8).collect()
    check(docs.collect(), got, 8)
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
    assert len(loads) == 8 and max(loads.values()) <= 1.02 * min(loads.values())
    slots = defaultdict(int)
    for r in got:
        slots[r.virtual_slot] += 1
    assert max(slots.values()) < 12


def test_a_new_map_folder(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/fresh"
    docs = make_docs([(i, "z" * i, "en", "s") for i in range(50)])
    check(docs.collect(), op.shard(docs, shards=4, slots=64, map_path=path).collect(), 4)
    assert op.load_map(spark, path).first().version == 2 and op.load_map(spark, path, 1).count() == 64


def test_map_versions_and_moves(spark, make_docs, tmp_path):
    path = f"file://{tmp_path}/map"
    op.save_map(op.first_map(spark, 4, 64), path)
    docs = make_docs([(i, "z" * (i % 50), "en", "s") for i in range(600)])
    op.shard(docs, shards=4, slots=64, map_path=path)
    assert op.load_map(spark, path).first().version == 2 and op.load_map(spark, path, 1).count() == 64
    sums = op.slot_sums(op.records(docs, slots=64))
    grown = op.rebalance(op.load_map(spark, path, 2), sums, 5)
    moved = grown.alias("n").join(op.load_map(spark, path, 2).alias("o"), "virtual_slot").where("n.shard <> o.shard")
    assert grown.count() == 64 and grown.first().version == 3
    assert moved.count() < 40 and moved.where("n.shard = 4").count() >= 8
    again = op.rebalance(grown, sums, 5)
    assert again.alias("n").join(grown.alias("o"), "virtual_slot").where("n.shard <> o.shard").count() <= 5


def test_no_python_in_the_plan(spark, make_docs):
    plan = op.shard(make_docs([(1, "a", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
