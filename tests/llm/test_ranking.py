from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from oracle import database, difference
from spreadloom.llm import queries, ranking


def terms(text: str | None) -> list[str]:
    low = (text or "").translate({k: k + 32 for k in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs: list, items: list, top: int) -> list:
    docs = [(k, w) for k, t in docs if (w := terms(t))]
    n_docs, total, out = len(docs), sum(len(w) for _, w in docs), []
    df: dict = {}
    for _, w in docs:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    for i, text in items:
        scored = []
        for k, w in docs:
            m = 100 - 50 + 50 * len(w) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in set(terms(text)) if t in df)
            scored += [(-s, k is None, k or 0)] if s > 0 else []
        out += [(i, r + 1, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def got(df) -> list:
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_documents(spark, data):
    assert not difference(spark, database(data), queries.op12_lexical_search, queries.ORACLE["op12_lexical_search"], data)


@pytest.mark.parametrize("postings", [20, 4_000_000])
def test_random_texts_ties_and_hot_documents(spark, monkeypatch, postings):
    monkeypatch.setattr(ranking, "SHARD_POSTINGS", postings)
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(60)] + ["Été", "ÉTÉ", "a_b", "naïve", "x\x00y", "İ"]
    draw = lambda n: " ".join(vocabulary[min(len(vocabulary) - 1, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(k, draw(rng.randint(1, 60))) for k in range(400)] + [(1000 + k, "t1 T2 t3") for k in range(300)]
    docs += [(None, "t1 t2 t40"), (None, "t1 t2 t40"), (7, "t1 t2 t40"), (7, "t1 t2 t40"), (2000, None), (2001, ""), (2002, "--- !"), (2003, "t5 " * 30_000), (-(2**62), "t50 t51")]
    rng.shuffle(docs)
    items = [(k, draw(rng.randint(1, 12))) for k in range(25)] + [(90, None), (91, ""), (92, "unknownword"), (93, "t1 t1 T1"), (93, "t4"), (None, "t6")]
    d = spark.createDataFrame([(*r, 1, 1, 1) for r in docs], "doc_id long, text string, n int, score int, item_id int").repartition(6)
    i = spark.createDataFrame([(*r, 1, 1) for r in items], "item_id long, text string, rank int, doc_id int")
    for top in (5, 50):
        assert got(ranking.search(d, i, top)) == brute(docs, items, top)


def test_blocks_of_items_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_ITEMS", 2)
    docs, items = [(k, f"a b{k} c{k % 3}") for k in range(20)], [(f"i{k}", f"b{k} c{k % 3} a") for k in range(5)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert got(ranking.search(d, i, 4)) == brute(docs, items, 4)
    for x, y in ((d.limit(0), i), (d, i.limit(0)), (d.limit(0), i.limit(0))):
        assert got(ranking.search(x, y)) == []


def test_documents_that_cannot_beat_the_heap_are_not_scored():
    rng = np.random.default_rng(2)
    weights = np.array([50, 60, 9000, 8000], np.int64)
    rows = [np.flatnonzero(rng.random(4) < (0.9, 0.8, 0.02, 0.01)).astype("<u4") for _ in range(20_000)]
    packed = [t.tobytes() + np.ones(len(t), "<u4").tobytes() for t in rows]
    shard = ranking.Shard(np.arange(len(rows)), np.full(len(rows), 100), packed, weights)
    heap = ranking.Heap(50)
    scored = shard.search(np.arange(4), heap)
    score = np.array([sum(int(weights[t]) * (10**9 // 3000) for t in r) for r in rows])
    order = np.lexsort((np.arange(len(rows)), -score))[:50]
    assert heap.doc.tolist() == order.tolist() and heap.score.tolist() == score[order].tolist()
    assert scored < len(rows) // 8
