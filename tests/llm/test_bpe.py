from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spreadloom.llm import bpe, queries


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def expected(library, text: str) -> tuple:
    ids = library.encode(text, add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_documents_as_the_library_does(spark, data, library):
    rows = {r.doc_id: r for r in queries.op3_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, d.text or "")


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(library, text):
    t = bpe.tokenizer(bpe.default_vocabulary())
    ids = t.encode(text)
    assert memoryview(ids).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids
    assert t.decode(ids).decode() == text


def test_corners(spark, library):
    schema = "doc_id long, text string, n_tokens string, ids int"
    texts = {1: None, 2: "", 3: "a<|endoftext|>b <|endoftext|>", 4: "x" * 20_000, 5: "word " * 30_000, 6: "\t\n  \r\n é 😀", 7: "it's I'LL we've"}
    docs = spark.createDataFrame([(k, v, "z", 1) for k, v in texts.items()] + [(None, "a", None, None)] * 2, schema)
    got = bpe.encode_decode(docs, with_ids=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts.get(r.doc_id, "a") or ""
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(library, text) and r.decoded == text and len(r.ids) == r.n_tokens
    assert bpe.encode_decode(spark.createDataFrame([], schema)).count() == 0
