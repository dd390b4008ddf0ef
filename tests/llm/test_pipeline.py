from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from spreadloom.llm import queries, textscan
from test_decontaminate import brute as contaminated
from test_exactdedup import brute as copies
from test_minhash import brute as near


@pytest.fixture(scope="module")
def steps(spark, data):
    """What each stage gets and returns."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, data)
        kept = [tuple(r) for r in got.collect()]
        out.append((name, docs, got.columns, kept))
        docs = spark.createDataFrame(kept, docs.schema) if name != "bpe" else docs
    return out


def texts(docs) -> list:
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_stages_and_columns(steps):
    assert [s[0] for s in steps] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    assert all(columns == docs.columns for _, docs, columns, _ in steps[:-1])
    assert all(len(kept) < docs.count() for name, docs, _, kept in steps[1:4]) and len(steps[0][3]) >= 0.9 * steps[0][1].count()


def test_each_stage_against_a_plain_version(spark, data, steps):
    _, docs, _, kept = steps[0]
    pred = {r.doc_id: r for r in queries.op2_language_id(spark, data).collect()}
    assert {r[0] for r in kept} == {k for k, r in pred.items() if r.lang_pred != "und" and r.score >= 0.5}
    _, docs, _, kept = steps[1]
    assert sorted(r[0] for r in kept) == sorted(k for k, _, _, ok, _ in copies(texts(docs)) if ok)
    _, docs, _, kept = steps[2]
    assert sorted(r[0] for r in kept) == sorted(k for k, c in near(texts(docs))[0].items() if k == c)
    _, docs, _, kept = steps[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    assert sorted(r[0] for r in kept) == sorted(x[0] for x in contaminated(texts(docs), items) if not x[5])
    _, docs, columns, kept = steps[4]
    decoded = {r[columns.index("doc_id")]: r[columns.index("decoded_sha256")] for r in kept}
    assert decoded == {r[0]: hashlib.sha256((r[1] or "").encode()).hexdigest() for r in texts(docs)}


def test_run_gives_the_last_stage(spark, data, steps):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, data).collect()) == sorted(steps[-1][3])


def test_stages_take_empty_tables_and_odd_rows(spark, data):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept int, score string"
    good = "The men of the town were in the house. They had come to see the old mill, and it was late. "
    rows = [(1, good, "en", "a", 1, None, None), (2, good, None, None, None, 1, "x"), (3, None, "en", "a", 0, 1, "x"), (None, good + "x", "en", "a", 1, 1, "x"), (4, "", "en", "a", 0, 1, "x"), (4, "", "en", "a", 0, 1, "x")]
    for odd in (rows, []):
        docs = spark.createDataFrame(odd, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, data)
            assert out.columns == docs.columns and out.count() <= len(odd)
            docs = out
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


def test_words_of_whole_columns():
    import pyarrow as pa

    col = pa.array(["Ab, c9", None, "", "é x\x1cy", "zz"])
    for a, buf, offs in textscan.steps(col):
        w = textscan.Words(buf, offs, "alnum")
        assert a == 0 and w.counts.tolist() == [2, 0, 0, 3, 1]
        h = w.hashes()
        assert len(set(h.tolist())) == 6 and h[0] == textscan.Words(*textscan.buffers(pa.array(["aB"])), "alnum").hashes()[0]
