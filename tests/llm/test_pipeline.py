"""The pipeline against the same stages by plain loops, and its stages on awkward rows."""

import __spark_entry__ as entry
import corpus_pipeline
from test_bestfit_packing import check as check_bins
from test_simhash_balls import plain_classes, plain_fingerprint

from threadlens.llm import language_mixture, quality_divergence, secret_crf

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert entry.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in entry.oracle_sql()
    names = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)}


def test_equals_plain_loops(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = {d.doc_id: d for d in table.collect()}
    verdicts = {r.doc_id: r.kept for r in quality_divergence.quality(table).collect()}
    good = spark.createDataFrame([d for i, d in docs.items() if verdicts[i]], table.schema)
    model = language_mixture.train(good)
    letters = language_mixture.letter_table()
    known = {}
    for d in good.collect():
        language, score, _ = language_mixture.mixtures([d.text], model, letters)[0]
        if language != "und" and score >= 0.3:
            known[d.doc_id] = d
    prints = {i: plain_fingerprint(d.text) for i, d in known.items()}
    classes = plain_classes(list(prints.items()))
    first = {i: known[i] for i in sorted(known) if classes[prints[i]] == i}
    crf = secret_crf.train(spark.createDataFrame(list(first.values()), table.schema))
    for i, d in first.items():
        text, at = "", 0
        for start, end, _ in secret_crf.find([d.text], crf)[0]:
            if start >= at:
                text += d.text[at:start] + secret_crf.MARK
            at = max(at, end)
        first[i] = (i, text + d.text[at:], d.lang, d.source, len(text + d.text[at:]))
    want = spark.createDataFrame(list(first.values()), table.schema)

    made = table
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, made, FOLDER)
        assert made.columns == table.columns
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    check_bins(corpus_pipeline.run(spark, FOLDER).collect(), want.collect(), 8192)


def test_awkward_rows_and_no_rows(spark, awkward, make_docs):
    for docs in (awkward, make_docs([])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, "").columns == docs.columns
            docs = stage(spark, docs, "")
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0
