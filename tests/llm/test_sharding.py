from __future__ import annotations

import hashlib
import math
import zlib

import pytest

from spreadloom.llm import queries, sharding

SCHEMA = "doc_id long, text string, shard string, slot string"


def checked(rows: list, n: int) -> None:
    for k in range(n):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots)))
    assert all(r.law == "key" and r.grown_shard in (r.shard, n) for r in rows)


def test_rows_sizes_and_slots(spark, data):
    rows = queries.op1_sharding(spark, data).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    checked(rows, 24)
    for r in rows:
        body = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(body) + 8, zlib.crc32(body))


def test_key_decides_and_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'x' AS text")
    small = {r.doc_id: r for r in sharding.shard(docs, [1.0] * 8).collect()}
    large = {r.doc_id: r.shard for r in sharding.shard(docs, [1.0] * 9).collect()}
    assert all(small[k].grown_shard == large[k] for k in small)
    moved = sum(large[k] != small[k].shard for k in small)
    assert 3000 / 9 * 0.7 < moved < 3000 / 9 * 1.3 and all(large[k] in (8, small[k].shard) for k in small)


def test_weights(spark):
    rows = sharding.shard(spark.range(4000).selectExpr("id AS doc_id", "'x' AS text"), [1.0, 3.0]).collect()
    assert 0.72 < sum(r.shard for r in rows) / 4000 < 0.78
    with pytest.raises(ValueError):
        sharding.shard(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"), [1.0, 0.0])


def test_nulls_hot_keys_clashing_columns_and_empty_tables(spark):
    rows = [(7, "same", "a", "b")] * 50 + [(None, None, None, None), (1, "", "x", "y"), (2, "é", "x", "y")]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(4), [1.0] * 3).collect()
    checked(got, 3)
    assert len({r.shard for r in got if r.doc_id == 7}) == 1 and len(got) == 53
    assert [(r["size"], r.text_crc32) for r in got if r.doc_id is None] == [(8, 0)]
    assert [r["size"] for r in got if r.doc_id == 2] == [10]
    assert sharding.shard(spark.createDataFrame([], SCHEMA), [1.0]).count() == 0


def test_same_shards_as_a_plain_version(spark, data):
    weights = [1.0, 2.0, 0.5, 1.5]

    def best(key: str, n: int) -> int:
        score = lambda s: -math.log((int(hashlib.md5(f"{key}#{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / [*weights, 3.0][s]
        return min(range(n), key=score)

    docs = spark.read.parquet(f"{data}/documents.parquet")
    for r in sharding.shard(docs, weights, grown_weight=3.0).collect():
        assert (r.shard, r.grown_shard) == (best(str(r.doc_id), 4), best(str(r.doc_id), 5))
