from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from spreadloom.llm import quality, queries

SCHEMA = "doc_id long, text string, score string, kept int"


def auc(y: np.ndarray, score: np.ndarray) -> float:
    rank = pd.Series(score).rank().to_numpy()
    good = y.sum()
    return (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


def test_agrees_with_labels_it_never_sees(spark, data):
    got = queries.op8_quality(spark, data).toPandas()
    assert len(got) == spark.read.parquet(f"{data}/documents.parquet").count()
    z = got.merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    assert auc(z["quality"].to_numpy(), z["score"].to_numpy()) > 0.95
    assert (z["kept"] == (z["quality"] == 1)).mean() > 0.9
    assert got["score"].between(0, 1).all() and got["weak_label"].between(0, 1).all()


def test_corners(spark):
    good = "The men of the town were in the house. They had come to see the old mill, and it was late. "
    rows = [(k, good * (1 + k % 4), "x", 1) for k in range(30)] + [(100 + k, "%%% BUY BUY $$$ ### " * 20, "x", 1) for k in range(8)]
    rows += [(200, None, None, None), (201, "", "x", 1), (202, " \n", "x", 1), (203, good * 3000, "x", 1), (None, good, "x", 1), (1, good * 2, "x", 1)]
    got = quality.scored(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all((by[k].score, by[k].kept) == (0.0, False) for k in (200, 201, 202))
    assert min(by[k].score for k in range(30)) > max(by[100 + k].score for k in range(8)) and by[203].kept
    assert quality.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.scored(spark.createDataFrame([(1, None, "x", 1)], SCHEMA)).collect()[0].score == 0


def test_measures():
    text = "Aa bb bb. cc\nAa bb bb. cc\n"
    m = quality.measures(*__import__("spreadloom.llm.textscan", fromlist=["buffers"]).buffers(pa.array([text, None, "x"])))
    name = {x[0]: k for k, x in enumerate(quality.LABELLERS)}
    assert m[0, name["lines"]] == 0.5 and m[0, name["shouting"]] == 2 / 16 and np.isnan(m[1]).all()
    assert m[0, name["stops"]] == 2 / len(text) and m[0, name["variety"]] == 0.5
    assert (quality.votes(m)[1] == 0).all()


def test_labellers_are_weighed_by_agreement():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.9, 0.85, 0.85, 0.8, 0.6, 0.5])
    says = np.where(rng.random((4000, 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    patterns, where, counts = np.unique(says @ (3 ** np.arange(8)), return_inverse=True, return_counts=True)
    p = quality.fit_labellers(patterns, counts.astype(float), 60)[where]
    assert ((p > 0.5) == truth).mean() > 0.93


def plain_votes(text: str | None) -> list[int]:
    """What each labeller says of one text, from its definition."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0] * 8
    size, n = len(data), len(words)
    capital, small = sum(65 <= b <= 90 for b in data), sum(97 <= b <= 122 for b in data)
    lines = [tuple(x.split()) for x in data.split(b"\n") if x.split()]
    m = [
        sum(b in b"*#$%&@~^=<>{}[]\\|!_+" for b in data) / size, capital / max(capital + small, 1), sum(chr(b).isascii() and chr(b).isalpha() or b >= 128 or b in b" \n" for b in data) / size,
        len(set(words)) / n * max(1, n / 300) ** 0.3, 1 - len(set(lines)) / len(lines), sum(map(len, words)) / n, data.count(b".") / size, sum(x == y for x, y in zip(words, words[1:], strict=False)) / n,
    ]
    return [1 if (v >= good if good > bad else v <= good) else 0 if (v <= bad if good > bad else v >= bad) else 2 for v, (_, good, bad) in zip(m, quality.LABELLERS, strict=True)]


def plain_posteriors(votes: list[list[int]], rounds: int) -> list[float]:
    """Expectation-maximisation document by document."""
    p = []
    for v in votes:
        q = (v.count(1) + 1) / (len(v) - v.count(2) + 2)
        p.append(min(q, 0.4) if 0 in v else q)
    for _ in range(rounds):
        good, bad = sum(p), sum(1 - q for q in p)
        says = lambda k, x, w: sum(y for v, y in zip(votes, w, strict=True) if v[k] == x)
        table = [[((says(k, x, p) + 1) / (good + 3), (says(k, x, [1 - q for q in p]) + 1) / (bad + 3)) for x in range(3)] for k in range(8)]
        z = [math.log((good + 1) / (bad + 1)) + sum(math.log(table[k][x][0] / table[k][x][1]) for k, x in enumerate(v)) for v in votes]
        p = [1 / (1 + math.exp(-max(-30, min(30, x)))) for x in z]
    return p


def test_weak_labels_equal_a_plain_version(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    votes = [plain_votes(r.text) for r in docs]
    want = dict(zip([r.doc_id for r in docs], plain_posteriors(votes, quality.Settings().rounds), strict=True))
    got = {r.doc_id: r.weak_label for r in queries.op8_quality(spark, data).collect()}
    assert got == pytest.approx(want, rel=1e-6, abs=1e-12) and len({tuple(v) for v in votes}) > 5
