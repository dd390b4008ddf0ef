from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spreadloom.llm import decontaminate, queries

DOCS, ITEMS = "doc_id long, text string, n_hit string, contaminated int", "item_id string, text string, doc_id long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs: list, items: list) -> list:
    windows: dict = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    sizes = sorted({len(x) for x in windows})
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for m in sizes:
            for k in range(len(w) - m + 1):
                if ids := windows.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    got = queries.op4_decontamination(spark, data).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute(docs, items)
    assert sorted(map(tuple, got)) == sorted(want) and any(x[5] for x in want)


@pytest.mark.parametrize("sent", [10, 20, 10**6])
def test_corners_in_several_passes(spark, monkeypatch, sent):
    rng = random.Random(5)
    vocabulary = ["a", "B", "ab", "é", "ß9", "Z"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 2, 3, 4, 9, 10, 11, 14])), k) for k in range(25)] + [("none", None, 1), ("empty", "", 1), (None, "a b", 1), ("twin", "ab ab ab", 1), ("twin", "ab ab ab", 1)]
    docs = [(k, text(rng.randrange(40)), "x", 1) for k in range(60)] + [(100, None, None, None), (101, "", "x", 0), (102, text(20_000), "x", 1), (None, "ab ab ab", "x", 1), (1, "a", "x", 1)]
    monkeypatch.setattr(decontaminate, "PASS_PATTERNS", 9)
    monkeypatch.setattr(decontaminate, "PASS_ITEMS", 7)
    monkeypatch.setattr(decontaminate, "SENT_PATTERNS", sent)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert (len(list(decontaminate._sendings(i, 10))) > 1) == (sent < 10**6)
    got = decontaminate.hits(d, i).collect()
    want = brute([r[:2] for r in docs], [r[:2] for r in items if r[0] is not None])
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)
    clean = decontaminate.decontaminated(d, i)
    assert clean.columns == d.columns and clean.count() == sum(not r[5] for r in want)


def test_empty_sides(spark):
    d, i = spark.createDataFrame([(1, "a b", "x", 1)], DOCS), spark.createDataFrame([], ITEMS)
    assert [tuple(r)[:4] for r in decontaminate.hits(d, i).collect()] == [(1, 2, 0, 0)]
    assert decontaminate.hits(spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "b", 1)], ITEMS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", min_size=1, max_size=12), min_size=1, max_size=8), st.text("ab ", max_size=60))
def test_search_finds_all_occurrences(patterns, text):
    p, t = sorted({x.encode() for x in patterns}), text.encode()
    want = sorted((k, x) for x in p for k in range(len(t)) if t.startswith(x, k))
    start, which = decontaminate.WuManber(p).search(t)
    assert sorted((k, p[x]) for k, x in zip(start.tolist(), which.tolist(), strict=True)) == want


def test_long_texts_and_many_patterns_in_bounded_memory():
    rng = random.Random(3)
    items = [[f"w{rng.randrange(10**6)}".encode() for _ in range(2009)] for _ in range(25)]
    patterns = [w for x in items for w in decontaminate.windows(x)]
    assert len(patterns) == 50_000
    by = decontaminate.WuManber(patterns)
    held = len(by.all.text) + sum(x.nbytes for _, _, _, *arrays in by.families for x in arrays) + by.size.nbytes + by.start.nbytes
    assert held < 25e6  # 100 MB for 200,000
    words = [f"v{rng.randrange(10**6)}".encode() for _ in range(50_000)]
    words[7000:7050] = items[3][100:150]
    start, which = by.search(b" " + b" ".join(words) + b" ")
    assert sorted(which.tolist()) == list(range(6100, 6141)) and len(set(start.tolist())) == 41


def test_items_without_an_id_are_searched_for(spark):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b", "x", 1), (2, "clean", "x", 1)], DOCS)
    got = {r.doc_id: r for r in decontaminate.hits(docs, spark.createDataFrame([(None, passage, 1)], ITEMS)).collect()}
    assert got[1].contaminated and got[1].n_hit == 12 and got[1].n_items == 0 and not got[2].contaminated
