from __future__ import annotations

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from spreadloom.llm import cqf, exactdedup, queries

SCHEMA = "doc_id long, text string, kept int, group_size string"


def normal(text: str | None) -> str:
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute(rows: list) -> list:
    groups: dict = {}
    for k, text in rows:
        groups.setdefault(normal(text), []).append(k)
    out = []
    for k, text in rows:
        g = groups[normal(text)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((k, keep, len(g), k == keep, hashlib.sha256(normal(text).encode()).hexdigest()))
    return out


def test_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    got = queries.op7_exact_dedup(spark, data).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(docs))


def test_space_nulls_and_hot_groups(spark):
    rows = [(k, "hot  group\n") for k in range(200)] + [(300, "hot group "), (301, "hot group"), (302, None), (303, ""), (304, " "), (305, " "), (306, "\t\n"), (307, "x\x1cy"), (308, "x y"), (309, "w " * 50_000), (310, "w  " * 50_000)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA).repartition(5)
    got = exactdedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows))
    kept = exactdedup.without_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _, _, ok, _ in brute(rows) if ok)


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a")] * 3 + [(None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d"), (3, "d")]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA)
    got = exactdedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    kept = exactdedup.without_copies(docs).collect()
    assert sorted((r.text, r.doc_id or 0) for r in kept) == [("a", 1), ("b", 0), ("c", 2), ("d", 2)]
    clash = docs.toDF("doc_id", "text", "__id", "__none").withColumn("__sha", F.lit("x")).withColumn("__c0", F.lit(7))
    again = exactdedup.without_copies(clash)
    assert again.columns == clash.columns and sorted((r.text, r.doc_id or 0) for r in again.collect()) == sorted((r.text, r.doc_id or 0) for r in kept)
    assert {(r["__id"], r["__none"], r["__sha"], r["__c0"]) for r in again.collect()} == {(1, "z", "x", 7)}
    empty = spark.createDataFrame([], SCHEMA)
    assert exactdedup.exact_duplicates(empty).count() == 0 and exactdedup.without_copies(empty).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)] * 2 + [np.full(1000, 12345, np.uint64)])
    parts: dict = {}
    for piece in np.array_split(rng.permutation(values), 7):
        for k, f in cqf.blocks(piece, 4):
            parts.setdefault(k, []).append(f.to_bytes(4))
    got = {}
    for k, ps in parts.items():
        v, n = cqf.merged(ps, k, 4)
        got.update(zip(v.tolist(), n.tolist(), strict=True))
    found, counts = np.unique(values, return_counts=True)
    assert got == dict(zip(found.tolist(), counts.tolist(), strict=True))


def test_filters_stay_small_however_many_blocks():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2)
    values = np.concatenate([values, values[:500], np.repeat(values[7], 200_000)])
    want = dict(zip(*(x.tolist() for x in np.unique(values, return_counts=True)), strict=True))
    for bits in (4, 11, 18):
        parts = [(k, f.to_bytes(bits)) for k, f in cqf.blocks(values, bits)]
        assert sum(len(p) for _, p in parts) < 20 * len(want)
        got: dict = {}
        for k, p in parts:
            v, n = cqf.merged([p], k, bits)
            got |= dict(zip(v.tolist(), n.tolist(), strict=True))
        assert got == want
    many = np.arange(200_000, dtype=np.uint64)  # one quotient's run is longer than an entry tells
    (k, f), = cqf.blocks(many, 4)
    assert cqf.merged([f.to_bytes(4)], k, 4)[0].tolist() == many.tolist()
