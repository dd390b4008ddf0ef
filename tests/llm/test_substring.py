from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from spreadloom.llm import queries, substring

SCHEMA = "doc_id long, text string, n_words string, did int"


def brute(rows: list, width: int = 20) -> list:
    seen, gone, split = {}, {}, {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        w = split[k] = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for s in range(len(w) - width + 1):
            if seen.setdefault(tuple(w[s : s + width]), (k, s)) != (k, s):
                gone.setdefault(k, set()).update(range(s, s + width))
    out = []
    for k, w in split.items():
        kept = [x for p, x in enumerate(w) if p not in gone.get(k, ())]
        out.append((k, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def test_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want = brute(docs)
    got = queries.op9_substring_dedup(spark, data).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any(r[2] for r in want)


def test_repeats_of_all_kinds(spark):
    rng = random.Random(2)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage, line = fresh(60), fresh(20)
    rows = [(k, f"{fresh(rng.randrange(30))}\n{passage if k % 3 == 0 else fresh(5)} {fresh(rng.randrange(30))}") for k in range(60)]
    rows += [(100, "a " * 500), (101, "a " * 30 + "b"), (102, line), (103, line + " " + line), (104, " ".join(line.split()[:19])), (105, None), (106, ""), (107, f"é\x1cx {line}\xa0y"), (108, fresh(20_000) + " " + passage)]
    rows += [(-5, passage), (200, " ".join(["a", "b"] * 40))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    assert sorted(map(tuple, substring.without_repeats(docs).collect())) == sorted(brute(rows))
    assert sorted(map(tuple, substring.without_repeats(docs, 5).collect())) == sorted(brute(rows, 5))


@pytest.mark.parametrize("crowded", [3, 1 << 40])
def test_small_groups_and_small_tasks(spark, monkeypatch, crowded):
    """Few suffixes a task, groups of a few bytes, and anchors that go by whole windows (or none of them)."""
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(120))) for k in range(80)] + [(100 + k, "x y z " * 40) for k in range(40)]
    rows += [(200 + k, f"start {k} " + "all of us say the same few words again and again " * 2 + f"then {k % 5} comes what {k % 3} is not the same") for k in range(60)]
    for name, value in (("HELD", 50), ("HELD_SUFFIXES", 70), ("GROUP_BYTES", 400), ("CROWDED", crowded)):
        monkeypatch.setattr(substring, name, value)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)
    assert sorted(map(tuple, substring.without_repeats(docs, 8).collect())) == sorted(brute(rows, 8))


def test_subtrees_go_by_words():
    """The tree of a group against a plain version; no hash tells suffixes apart."""
    rng = random.Random(7)
    for vocabulary in (["a", "b", "ab"], [f"w{k}" for k in range(70_000)]):
        base = [rng.choice(vocabulary) for _ in range(40_000 if len(vocabulary) > 9 else 300)]
        cut = [(rng.randrange(len(base) - 30), rng.randrange(1, 14)) for _ in range(6000 if len(vocabulary) > 9 else 200)]
        did = np.array([rng.randrange(50) for _ in cut])
        start, n = np.arange(len(cut)) * 100, np.array([m for _, m in cut])
        words = [" ".join(base[k : k + m + 7]).encode() for k, m in cut]
        segment, nth, later = substring.Segments(pa.array(words, pa.binary()), did, start, n).subtree(8)
        first: dict = {}
        for s in sorted(range(len(cut)), key=lambda s: (did[s], start[s])):
            for k in range(n[s]):
                first.setdefault(tuple(base[cut[s][0] + k : cut[s][0] + k + 8]), (s, k))
        want = [first[tuple(base[cut[s][0] + k : cut[s][0] + k + 8])] != (s, k) for s, k in zip(segment.tolist(), nth.tolist(), strict=True)]
        assert later.tolist() == want and any(want) and not all(want)


def test_repeated_and_null_ids_and_empty(spark):
    text = " ".join(f"t{k}" for k in range(30))
    rows = [(1, text), (1, text), (1, "other"), (None, text), (2, text)]
    got = substring.without_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), with_text=True).collect()
    assert len(got) == 5
    assert {(r.doc_id, r.n_removed) for r in got if r.doc_id in (None, 2)} == {(None, 0), (2, 30)}
    assert len({r.n_removed for r in got if r.doc_id == 1 and r.n_words == 30}) == 1
    assert substring.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_ids_that_repeat(spark):
    rng = random.Random(5)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b = fresh(30), fresh(25)
    ids = (6 * 10**18, -6 * 10**18, 2**63 - 1, -(2**63) + 2**62)
    rows = [(k, f"{fresh(9)} {t} {fresh(4)}") for k in ids for t in (a, b, fresh(30))] + [(ids[0], f"{a} and {a}"), (5, a), (5, fresh(40))]
    got = substring.without_repeats(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4), with_text=True).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) == 30 * 6 + 25 * 3
    least = min(ids)  # the smallest doc_id has the first of each passage
    assert {t for t in (a, b) for r in got if r.doc_id == least and t in r.kept_text} == {a, b}
    assert not [r for r in got if r.doc_id != least and (a in r.kept_text or b in r.kept_text)]
