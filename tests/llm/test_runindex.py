from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from oracle import database, difference
from spreadloom.llm import queries, runindex


def brute(rows: list, width: int) -> list:
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[k : k + width] for t in texts for k in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - width + 1):
            if count[t[k : k + width]] > 1:
                gone[k : k + width] = True
        kept = bytes(b for b, g in zip(t, gone, strict=False) if not g)
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df) -> list:
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


def test_documents(spark, data):
    assert not difference(spark, database(data), queries.op11_suffix_array_dedup, queries.ORACLE["op11_suffix_array_dedup"], data)


def texts(seed: int) -> list:
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passages = [word(rng.randint(15, 120)) for _ in range(8)]
    rows = [(k, word(rng.randint(0, 40)) + rng.choice(passages) + word(rng.randint(0, 25)) + rng.choice(passages)[rng.randint(0, 9) :] + word(5)) for k in range(60)]
    line = word(34)
    rows += [(100 + k, word(21) + line + word(21)) for k in range(120)]  # one line, its surroundings all different
    rows += [(300 + k, "hot copy " * 9) for k in range(80)]
    rows += [(400, "a" * 500), (401, "a" * 90), (402, "ab" * 300 + "c"), (403, "ab" * 40), (404, None), (405, ""), (406, "x" * 39), (407, "y" * 40), (408, "\x00" * 100), (409, "é" * 60), (410, "0123456789" * 3_000)]
    rows += [(None, passages[0] * 2), (None, passages[0] * 2), (None, None), (1, "same id " + passages[1]), (2, rows[2][1]), (-(2**62), passages[2]), (2**62, passages[2]), (2**62, passages[3])]
    return rows


@pytest.mark.parametrize(("seed", "crowded"), [(1, 3000), (2, 3)])
def test_windows_of_forty_bytes(spark, monkeypatch, seed, crowded):
    monkeypatch.setattr(runindex, "CROWDED", crowded)
    monkeypatch.setattr(runindex, "GROUP_BYTES", 2000)
    monkeypatch.setattr(runindex, "DIGEST_BYTES", 4000)
    monkeypatch.setattr(runindex, "MOST_WINDOWS", 64)
    rows = texts(seed)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, d int, th int, runs int").repartition(5)
    assert got(runindex.without_repeats(docs, 40, (12, 30, 40))) == brute(rows, 40)


def test_kept_bytes_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 10 + "k" * 3 + "0123456789" * 5), (2, "0123456789" * 5 + "tail")], "doc_id long, text string")
    kept = {r.doc_id: bytes(r.kept_text) for r in runindex.without_repeats(docs, 40, (12, 30, 40), with_text=True).collect()}
    assert kept == {1: b"x" * 10 + b"kkk", 2: b"tail"}
    assert runindex.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", [b"banana", b"a" * 700, b"ab" * 350 + b"c", bytes(100), bytes(range(200)) * 4, b"x", bytes(9) + b"\x01" + bytes(9)])
def test_run_index(text):
    t = np.frombuffer(text, np.uint8)
    sa = runindex.suffix_array(t)
    assert sa.tolist() == sorted(range(len(text)), key=lambda k: text[k:])
    index = runindex.RunIndex(t)
    assert index.length.sum() == len(text) and b"".join(bytes([c]) * n for c, n in zip(index.letter.tolist(), index.length.tolist(), strict=True)) == bytes(text[k - 1] for k in sa)
    want = []
    for k in range(len(text)):
        n = 0
        while k + n < len(text) and text.find(text[k : k + n + 1]) != -1 and (text.find(text[k : k + n + 1]) != k or text.find(text[k : k + n + 1], k + 1) != -1):
            n += 1
        want.append(n)
    assert index.matching().tolist() == want


def test_anchors_of_equal_windows_are_equal():
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(300)) * 3 + "".join(rng.choice("abcdefgh") for _ in range(3000))
    buf = np.frombuffer(text.encode(), np.uint8)
    for run in (12, 30, 40):
        row, lo, n, h, _ = runindex.stretches(buf, np.array([0, 901, 901, len(buf)]), 40, run)
        starts = np.concatenate([a + np.arange(m) for a, m in zip(lo, n, strict=True)])
        assert starts.tolist() == [*range(901 - 39), *range(901, len(buf) - 39)]
        anchor: dict = {}
        for s, a in zip(starts.tolist(), np.repeat(h, n).tolist(), strict=True):
            assert anchor.setdefault(text[s : s + 40], a) == a
