from __future__ import annotations

import zlib

import pytest

from spreadloom.llm import langid, queries


@pytest.fixture(scope="module")
def net(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return langid.train(langid.sample(docs.where(~langid.held_out()), langid.Settings()), langid.Settings())


def test_held_out_accuracy(spark, data):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op2_language_id(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.95 * len(known) > 0


def test_only_text_decides(spark, net):
    schema = "doc_id long, text string, lang string, lang_pred int"
    text = "Les hommes sont dans une maison et ils ne sont pas avec leur père. "
    rows = [(1, text, "en", 1), (2, text, None, None), (3, None, "en", 0), (4, "", "fr", 0), (5, " 12 +- 3 ", "fr", 0), (None, text, "de", 9), (6, text * 3000, "x", 1)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(rows, schema), net).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[None].lang_pred == got[6].lang_pred and got[1].score == got[2].score
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (3, 4, 5))
    assert langid.predict(spark.createDataFrame([], schema), net).count() == 0


def test_windows_cover_the_whole_text(net):
    import numpy as np
    import pyarrow as pa

    texts = ["", None, "é" * 700, "abc"]
    rows, sizes = [], []
    for r, x in langid.windows(pa.array(texts), net, at_once=2):
        rows += r.tolist()
        sizes += (x > 0).sum(1).tolist()
    assert np.bincount(rows, sizes, 4).tolist() == [0, 0, 1400, 3]


def test_gradients_fit_and_nothing_to_learn(spark):
    net = langid.train([("aaaa bbbb " * 30, "x"), ("zzzz yyyy " * 30, "y")] * 20)
    docs = spark.createDataFrame([(1, "bbbb aaaa aaaa"), (2, "yyyy zzzz yyyy")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(docs, net).orderBy("doc_id").collect()] == ["x", "y"]
    assert langid.train([]) is None
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_identified_keeps_columns(spark, net, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumnRenamed("source", "score")
    kept = langid.identified(docs, net)
    assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
