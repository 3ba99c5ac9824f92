import numpy as np

from threadlens.llm import language_mixture as op

SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog while children are playing with their friends in the garden",
    "de": "der schnelle braune fuchs springt über den faulen hund während kinder mit ihren freunden im garten spielen",
    "fr": "le rapide renard brun saute par dessus le chien paresseux pendant que les enfants jouent dans le jardin",
}


def trained(make_docs):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(text.split())), g, "s") for g, text in SAMPLES.items() for i in range(8)]
    return op.train(make_docs([*rows, (900, None, "en", "s"), (901, "text without language", None, "s")]))


def test_predictions_and_mixtures(spark, make_docs):
    model = trained(make_docs)
    assert model.languages == ["de", "en", "fr"]
    half = SAMPLES["en"] + " " + SAMPLES["en"] + " " + SAMPLES["de"]
    docs = make_docs([(1, "The friends are playing with the dog", None, "x"), (2, half, "fr", "x"), (3, "Die Kinder spielen im Garten", None, None), (4, "1234 !!", "en", "s"), (5, None, "en", "s"), (5, None, "en", "s")])
    got = {r.doc_id: r for r in op.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["en", "en", "de", "und", "und"]
    assert {x.lang for x in got[2].languages} == {"en", "de"} and abs(got[2].languages[0].share - 2 / 3) < 0.1
    assert len(got[1].languages) == 1 and all(0 <= r.score <= 1 for r in got.values())
    kept = op.keep_identified(docs, model)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3] and kept.columns == docs.columns


def test_em_finds_the_likeliest_shares():
    random = np.random.default_rng(4)
    like = random.random((2, 60)).astype(np.float32)
    shares, found = op.fit_shares(like, np.array([0, 25]), np.repeat([0, 1], [25, 35]), np.ones((2, 2)))
    for number, part in enumerate((like[:, :25], like[:, 25:])):
        grid = np.linspace(0, 1, 2001)
        values = [np.log(part[0] * g + part[1] * (1 - g)).sum() for g in grid]
        assert found[number] >= max(values) - 0.05


def test_held_out_accuracy(spark):
    from threadlens.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op3_language_mixture"](spark, folder).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_awkward_rows_and_no_rows(spark, awkward, make_docs):
    model = op.train(awkward)
    assert op.identify(awkward, model).count() == awkward.count()
    empty = op.train(make_docs([]))
    got = op.identify(awkward, empty).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert op.identify(make_docs([]), model).count() == 0


def test_rare_languages_are_learned(spark, make_docs):
    # Greek has less than a thousandth of the letters
    rows = [(i, " ".join([SAMPLES["en"]] * 60), "en", "s") for i in range(60)] + [(900, "η γάτα και ο σκύλος κάθονται μαζί στο χαλί", "el", "s")]
    model = op.train(make_docs(rows))
    assert model.languages == ["el", "en"]
    got = op.identify(make_docs([(1, "ο σκύλος και η γάτα στο χαλί", None, "s"), (2, SAMPLES["en"], None, "s")]), model).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {1: "el", 2: "en"}
