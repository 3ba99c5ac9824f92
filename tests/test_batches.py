import pytest

from threadlens.sources import batches as op

SCHEMA = "post_id string, subreddit string, bodies array<string>, n int"
ROWS = [("a", "s1", ["x, \"y\"", "line\nbreak"], 1), ("b", "s2", [], None), (None, "s1", None, 3)]


@pytest.mark.parametrize("format", op.FORMATS)
@pytest.mark.parametrize("partition_by", [None, ["subreddit"]])
def test_a_batch_counts_once(spark, rows, tmp_path, format, partition_by):
    root = str(tmp_path / "posts")
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert op.write_batch(df, root, "one", format, partition_by)
    assert not op.write_batch(df, root, "one", format, partition_by)
    assert op.write_batch(df.limit(1), root, "two", format, partition_by)
    got = op.read_batches(spark, root)
    assert got.columns == ["post_id", "subreddit", "bodies", "n", "batch"]
    want = [(*r, "one") for r in ROWS] + [(*ROWS[0], "two")]
    assert rows(got) == sorted(want, key=repr)
    assert rows(op.read_batches(spark, root, ["two"]), "post_id") == [("a",)]


def test_a_broken_try_is_never_read(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "posts")
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert op.write_batch(df, root, "one")

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(op._Files, "put_new", stop)  # all rows are written, the commit is not
        with pytest.raises(RuntimeError):
            op.write_batch(df, root, "two")
    assert op.read_batches(spark, root).count() == 3 and set(op.committed(spark, root)) == {"one"}
    assert op.write_batch(df, root, "two")
    assert op.read_batches(spark, root).count() == 6
    assert op.drop_uncommitted(spark, root) == 1 and op.drop_uncommitted(spark, root) == 0
    assert op.read_batches(spark, root).count() == 6


def test_two_jobs_at_once_commit_one(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "posts")
    df = spark.createDataFrame(ROWS, SCHEMA)
    inner, during = op._Files.put_new, []

    def late(self, *rest):
        if not during:
            during.append(True)
            assert op.write_batch(df.limit(1), root, "one")  # another job commits first
        return inner(self, *rest)

    monkeypatch.setattr(op._Files, "put_new", late)
    assert not op.write_batch(df, root, "one")
    assert op.read_batches(spark, root).count() == 1


def test_new_columns_empty_batches_and_names(spark, rows, tmp_path):
    root = str(tmp_path / "posts")
    with pytest.raises(ValueError):
        op.read_batches(spark, root)
    assert op.write_batch(spark.createDataFrame([], SCHEMA), root, "none")
    assert op.read_batches(spark, root).count() == 0
    assert op.write_batch(spark.createDataFrame([("z", 5)], "post_id string, extra int"), root, "more", "json")
    assert rows(op.read_batches(spark, root), "post_id", "n", "extra", "batch") == [("z", None, 5, "more")]
    with pytest.raises(ValueError):
        op.read_batches(spark, root, ["other"])
    with pytest.raises(ValueError):
        op.write_batch(spark.createDataFrame(ROWS, SCHEMA), root, "a/b")
    with pytest.raises(ValueError):
        op.write_batch(spark.createDataFrame(ROWS, SCHEMA), root, "x", "text")
