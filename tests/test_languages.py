import os
from collections import Counter
from math import log

import pytest
from pyspark.sql import functions as F

from threadlens.operators import languages as op

SF = os.environ.get("THREADLENS_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


def brute(train, text):
    """Naive Bayes with plain loops."""
    grams = lambda t: [f" {w} "[i : i + 3] for w in "".join(c if c.isalpha() else " " for c in t.lower()).split() for i in range(len(w))]
    counts = {}
    for t, g in train:
        if g is not None:
            counts.setdefault(g, Counter()).update(grams(t or ""))
    counts = {g: c for g, c in counts.items() if c}
    different = len(set().union(*counts.values()))
    mine = grams(text or "")
    if not mine:
        return None
    unit = lambda x: int(log(x) * 1e6 + (0.5 if x >= 1 else -0.5))
    score = {g: len(mine) * unit(0.5 / (sum(c.values()) + 0.5 * different)) + sum(unit((c[x] + 0.5) / 0.5) for x in mine if c[x]) for g, c in counts.items()}
    return min(score, key=lambda g: (-score[g], g))


TRAIN = [
    ("the cat and the dog are on the mat with the hat", "en"),
    ("der Hund und die Katze sind auf der Matte für dich", "de"),
    ("le chat et le chien sont sur le tapis avec élan", "fr"),
    ("кот и собака на ковре", "ru"),
    ("猫 と 犬", "ja"),
    ("nothing known here", None),
    (None, "en"),
    ("", "it"),
]


def test_equals_plain_loops(spark):
    profiles = op.learn_profiles(spark.createDataFrame(TRAIN, "text string, language string"))
    assert profiles.languages == ["de", "en", "fr", "ja", "ru"]
    asked = ["the hat", "die Matte", "le tapis", "собака", "犬", "", None, "123 !?", "zzzz", "THE Chat", "the der le " * 3000]
    df = spark.createDataFrame(list(enumerate(asked)), "text_id int, text string")
    got = {r.text_id: r.detected for r in op.detect_languages(df, profiles).collect()}
    assert got == {i: brute(TRAIN, t) for i, t in enumerate(asked)}


def test_no_labels_and_no_texts(spark):
    none = op.learn_profiles(spark.createDataFrame([("a", None)], "text string, language string"))
    df = spark.createDataFrame([(1, "some text")], "text_id int, text string")
    assert [tuple(r) for r in op.detect_languages(df, none).collect()] == [(1, None)]
    some = op.learn_profiles(spark.createDataFrame(TRAIN, "text string, language string"))
    assert op.detect_languages(df.limit(0), some).count() == 0


def test_saved_profiles_tell_the_same(spark, tmp_path):
    profiles = op.learn_profiles(spark.createDataFrame(TRAIN, "text string, language string"))
    op.save_profiles(profiles, str(tmp_path / "p"))
    again = op.load_profiles(spark, str(tmp_path / "p"))
    df = spark.createDataFrame([(1, "the cat"), (2, "собака")], "text_id int, text string")
    assert again[:2] == profiles[:2]
    assert sorted(map(tuple, op.detect_languages(df, again).collect())) == [(1, "en"), (2, "ru")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_accuracy_on_texts_not_learned_from(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("text_id"), "text", "lang")
    profiles = op.learn_profiles(rows.where("text_id % 3 <> 0"), "text", "lang")
    held = rows.where("text_id % 3 = 0")
    told = op.detect_languages(held, profiles).join(held.select("text_id", "lang"), "text_id")
    right, count = told.agg(F.count_if(F.col("detected") == F.col("lang")), F.count("*")).first()
    assert count > 200 and right / count > 0.95
    # a few words are enough for most
    short = held.withColumn("text", F.substring("text", 20, 60))
    told = op.detect_languages(short, profiles).join(held.select("text_id", "lang"), "text_id")
    right, count = told.agg(F.count_if(F.col("detected") == F.col("lang")), F.count("*")).first()
    assert right / count > 0.9


def test_collecting_by_profiles(spark):
    from threadlens.plans.collection import collect_posts

    profiles = op.learn_profiles(spark.createDataFrame(TRAIN, "text string, language string"))
    posts = spark.createDataFrame(
        [(f"p{i}", "s", t, t, ("a",), float(i), 1, 1.0, "u", True) for i, t in enumerate(["the cat and the dog", "der cat und die Katze", "the cat"])],
        "id string, subreddit string, title string, selftext string, author struct<name:string>, created_utc double, score long, upvote_ratio double, url string, is_self boolean",
    )
    comments = spark.createDataFrame(
        [("p0", "c1", 0, "t3_p0", ("x",), "the dog", 1.0, 1), ("p0", "c2", 1, "t3_p0", ("y",), "die Katze und der Hund", 1.0, 1)],
        "post_id string, id string, comment_rank int, parent_id string, author struct<name:string>, body string, created_utc double, score long",
    )
    found = {r.post_id: r for r in collect_posts(posts, comments, {"en": ["cat"]}, {}, check_comments_language=True, profiles=profiles).collect()}
    assert set(found) == {"p0", "p2"} and found["p0"].comments_bodies == ["the dog"]
