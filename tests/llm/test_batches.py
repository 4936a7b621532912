"""What goes to Python at once."""

import corpus_pipeline
from scoreloom.llm import _common, language_id


def test_batches_are_small_within_a_run_and_set_back(spark):
    before = spark.conf.get(_common.BATCH)
    for own, wanted in ((before, _common.MOST_ROWS), ("0", _common.MOST_ROWS), ("7", 7)):
        spark.conf.set(_common.BATCH, own)
        try:
            with _common.Scratch(spark, "batches") as run:
                with run.part():
                    assert int(spark.conf.get(_common.BATCH)) == wanted
                assert int(spark.conf.get(_common.BATCH)) == wanted
            assert spark.conf.get(_common.BATCH) == own
        finally:
            spark.conf.set(_common.BATCH, before)


def test_language_stage_sends_each_text_once(spark, monkeypatch):
    sent, predict = [], language_id.predict
    monkeypatch.setattr(language_id, "predict", lambda docs, net: (sent.append(docs.schema), predict(docs, net))[1])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert corpus_pipeline.identified(spark, docs, "").columns == docs.columns
    assert sorted(s.simpleString().count("text:") for s in sent) == [1, 1] and sorted(len(s) for s in sent) == [2, 4]
