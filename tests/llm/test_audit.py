from __future__ import annotations

import re
from itertools import permutations

import pytest

from oracle import database, difference
from spreadloom.llm import audit, queries

SCHEMA = "doc_id long, text string, lang string, quality string, mask long, n int"


def test_documents(spark, data):
    assert not difference(spark, database(data), queries.op13_filter_audit, queries.ORACLE["op13_filter_audit"], data)


def brute(rows: list, labels: dict) -> list:
    sets = []
    for k, text, lang in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": k is not None and any(j is not None and j < k and (u or "") == t for j, u, _ in rows),
        }
        sets.append((lang or "", {f for f, bad in fails.items() if bad}, *labels.get(k, (False, False))))
    out = []
    for part in {s[0] for s in sets}:
        own, shapley, lines = [s[1:] for s in sets if s[0] == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone, stays = [s for s in left if f in s[0]], [s for s in left if f not in s[0]]
                shapley[f] += len(gone)
                lines.append((part, order, k + 1, len(stays), len(gone), sum(f in s[0] for s in own) - len(gone), sum(s[0] == {f} for s in own), sum(s[1] for s in gone), sum(s[2] for s in gone), f))
                left = stays
        out += [(*x[:-1], shapley[x[-1]]) for x in lines]
    return sorted(out)


NAMES = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def test_nulls_copies_and_clashing_columns(spark):
    words = " ".join(f"w{k}" for k in range(250))
    texts = [None, "", " \t", words, words, words + " |", "A B " + words, "A " * 300, "x " * 199, "x " * 200, "ÄÖ é " * 120, words.upper(), "y " * 30_000, words, words + "\x1c"]
    rows = [(k, t, ["en", None, "", "de"][k % 4]) for k, t in enumerate(texts)]
    rows += [(None, words, "en"), (None, words, "de"), (3, words, "en"), (3, words, "en"), (4, "other " * 250, None), (-7, "hot", "en"), *((100 + k, "hot", "en") for k in range(300))]
    docs = spark.createDataFrame([(*r, "q", 9, 1) for r in rows], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(0, 1, 0, "x"), (3, 1, None, "x"), (3, 0, 1, "x"), (5, None, 1, "x"), (-7, 1, 1, "x"), (None, 1, 1, "x"), (999, 1, 1, "x"), (200, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    known = {0: (True, False), 3: (True, True), 5: (False, True), -7: (True, True), 200: (True, True)}
    got = audit.audited(docs, labels)
    assert tuple(got.columns) == NAMES
    assert sorted(map(tuple, got.collect())) == brute(rows, known)


@pytest.mark.parametrize("held", [1, 200])
def test_many_parts(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD_PARTS", held)
    rows = [(k, f"t {k % 40}", f"l{k % 17}") for k in range(120)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, audit.audited(docs, labels).collect())) == brute(rows, {1: (True, True)})
    assert audit.audited(docs.limit(0), labels.limit(0)).count() == 0


def test_table():
    for mask in range(32):
        failing = {f for k, f in enumerate("ABCDE") if mask >> k & 1}
        for k, order in enumerate(audit.ORDERS):
            assert audit.FIRST[mask, k] == next((s for s, f in enumerate(order) if f in failing), 5)
