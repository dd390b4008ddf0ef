from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spreadloom.llm import minhash, queries

SCHEMA = "doc_id long, text string, class_id string, kept int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows: list, s: minhash.Settings = minhash.Settings()) -> tuple[dict, list]:
    """(class of each doc_id, links between different texts) by comparing all pairs."""
    sets, often = {}, Counter()
    for k, text in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        if w:
            sets[k] = Counter(tuple(w[i : i + s.width]) for i in range(max(1, len(w) - s.width + 1)))
            often.update(sets[k].keys())
    idf = lambda n: (math.log((2 + len(rows)) / (1 + n)) / math.log((2 + len(rows)) / 2)) ** s.power
    own = {k: {x: c * idf(often[x]) for x, c in v.items()} for k, v in sets.items()}
    total = {k: sum(v.values()) for k, v in own.items()}
    label = {k: k for k, _ in rows}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    links, keys = [], sorted(own)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if min(total[a], total[b]) < 0.79 * max(total[a], total[b]):
                continue
            both = sum(min(v, own[b][x]) for x, v in own[a].items() if x in own[b])
            if both >= s.similarity * (total[a] + total[b] - both) - 1e-6:
                links.append((b, a))
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {k: root(k) for k, _ in rows}, links


def test_documents(spark, data):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    want, links = brute(docs)
    rows = queries.op6_near_dedup(spark, data).collect()
    assert {r.doc_id: r.class_id for r in rows} == want and links
    assert all(r.kept == (r.class_id == r.doc_id) for r in rows)
    assert {r.doc_id for r in rows if r.n_links} == {k for pair in links for k in pair}


def family(rng: random.Random, n: int, size: int, share: float) -> list[str]:
    """Texts that all hold one passage and differ in the rest."""
    passage = [f"p{k}" for k in range(int(size * share))]
    return [" ".join(passage + [f"w{rng.randrange(10**7)}" for _ in range(size - len(passage))]) for _ in range(n)]


@pytest.mark.parametrize("block", [1 << 9, 1 << 15])
def test_crowded_buckets_keep_their_links(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "OPEN_BLOCK", block)
    monkeypatch.setattr(minhash, "MEMBER_BLOCK", 2 * block)
    rng = random.Random(4)
    rows = list(enumerate(family(rng, 120, 120, 0.75)))  # in common buckets, yet no pair is near enough
    for k in range(30):  # near copies of some of them
        words = rows[k * 4][1].split()
        words[100 + k % 20] = "changed"
        rows.append((1000 + k, " ".join(words)))
    rows += [(2000 + k, "hot copy of one text with a few more words " + "and so on " * 20) for k in range(100)]
    rng.shuffle(rows)
    want, _ = brute(rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(4)).collect()}
    assert got == want


def bucketed(spark, rows: list, s: minhash.Settings):
    """(members, sets) of one bucket that holds all rows."""
    sets = minhash.signed(spark.createDataFrame(rows, "did long, text string"), s).cache()
    return sets.selectExpr("2L as key", f"{len(rows)}L as n", "did as rep", "c1", "size").repartition(4), sets.select("did", "hashes", "weights")


def joined(links) -> dict:
    label: dict = {}

    def root(k):
        while label.setdefault(k, k) != k:
            k = label[k]
        return k

    for a, b in links:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    return {k: root(k) for k in label}


def test_no_link_of_a_crowded_bucket_is_lost(spark, monkeypatch):
    """A thousand different texts in one bucket, pairs of similarities of 0.80 to 0.85 among them: all are found."""
    monkeypatch.setattr(minhash, "OPEN_BLOCK", 5000)
    monkeypatch.setattr(minhash, "MEMBER_BLOCK", 12_000)
    rng = random.Random(8)
    rows = list(enumerate(family(rng, 800, 104, 0.3)))
    for k in range(200):  # one changed stretch of words
        words = rows[k * 4][1].split()
        words[90:96] = [f"v{rng.randrange(10**7)}" for _ in range(3 + k % 3)] + words[93 + k % 3 : 96]
        rows.append((1000 + k, " ".join(words)))
    s = minhash.Settings()
    _, want = brute(rows, s)
    assert len(want) >= 100
    got = minhash.links(*bucketed(spark, rows, s), s).collect()
    assert joined((r.a, r.b) for r in got) == joined(want)


def test_links_between_linked_members_are_found(spark):
    """Chains of near copies of which no end is near the next one's: every step is compared, whoever leads."""
    rng = random.Random(5)
    words, rows = [f"w{k}" for k in range(150)], []
    for k in range(40):
        rows.append((k, " ".join(words)))
        at = rng.randrange(140)
        words[at : at + 3] = [f"x{rng.randrange(10**7)}" for _ in range(3)]
    s = minhash.Settings(power=0)
    _, want = brute(rows, s)
    got = minhash.links(*bucketed(spark, rows, s), s).collect()
    assert joined((r.a, r.b) for r in got) == joined(want) and len(joined(want)) == 40


def test_texts_of_all_lengths_meet(spark):
    rng = random.Random(6)
    rows = []
    for k, n in enumerate([190, 198, 204, 230, 320, 390, 402, 410, 600]):
        words = [f"w{rng.randrange(10**7)}" for _ in range(n)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[: int(n * 0.93)])), (10 * k + 2, " ".join([*words, *words[:10]]))]
    want, _ = brute(rows)
    got = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    assert got == want and len(set(want.values())) == 9


def test_nulls_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " -- "), (4, "one two"), (5, "One, two!"), (6, "one two three"), (7, "x " * 20_000), (8, "x " * 20_001), (9, None), (4, "one two")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, "one two", None, None)], SCHEMA)
    got = minhash.classes(docs).collect()
    assert len(got) == 11
    by = {r.doc_id: r.class_id for r in got}
    assert by == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, None: None}
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 7, 9]
    assert minhash.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_shingle_is_counted(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(["a b c d e"] * (k % 3 == 0) + ["q r s t u"] * (k < 21) + [f"w{rng.randrange(40)}" for _ in range(12)])) for k in range(300)]
    s = minhash.Settings(chunk_bytes=2000, block_hashes=300)
    often: Counter = Counter()
    for _, text in rows:
        w = text.split()
        often.update({" ".join(w[i : i + 5]) for i in range(len(w) - 4)})
    for r in minhash.signed(spark.createDataFrame(rows, "did long, text string"), s).collect():
        w = rows[r.did][1].split()
        own = Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
        _, h, _ = minhash.shingles(pa.array(list(own)), 5)
        want = dict(zip((h >> np.uint64(24)).tolist(), (c * minhash.idf(np.array([often[x]]), 300, s.power)[0] for x, c in own.items()), strict=True))
        _, h, w = minhash._held(pa.array([r.hashes]), pa.array([r.weights]))
        assert dict(zip((h >> np.uint64(24)).tolist(), w.tolist(), strict=True)) == pytest.approx(want)


def test_rows_that_share_a_doc_id(spark):
    words = [f"w{k}" for k in range(60)]
    one, near, other = " ".join(words), " ".join([*words, "more"]), " ".join(f"v{k}" for k in range(60))
    docs = spark.createDataFrame([(1, one, None, None), (5, near, None, None), (5, other, None, None), (7, other, None, None), (7, other, None, None)], SCHEMA)
    got = sorted((r.doc_id, r.class_id, r.kept) for r in minhash.classes(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (7, 1, False)]  # doc 5's texts are one document's
    assert [r.doc_id for r in minhash.without_near_copies(docs).collect()] == [1]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(9)
    h = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
    w = rng.uniform(0.5, 6, (2, 120)).astype(np.float32)
    want = np.minimum(*w).sum() / np.maximum(*w).sum()
    same = []
    for seed in range(40):
        hh = minhash.mix(h + np.uint64(seed))
        samples = minhash.signatures(np.array([0, 120]), np.tile(hh, 2), w.ravel(), 48)
        same.append((samples[0] == samples[1]).mean())
    assert abs(np.mean(same) - want) < 0.03


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (300, 300)]
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(41), 100], 0), 200: 200, 201: 200, 300: 300}
