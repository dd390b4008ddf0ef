from __future__ import annotations

import random
import re
from re import _constants as C
from re import _parser

import pytest

from spreadloom.llm import licenses, queries

SCHEMA = "doc_id long, text string, labels string, score int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    first = [k for k, _ in at]
    return len(w), len(at), min(first, default=None), max(first, default=None), ",".join(sorted({x for _, x in at}))


def twin(text: str | None) -> tuple:
    """(detections that stand, score) by trying all rules and comparing all pairs of places."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    norm, found = " " + " ".join(w) + " ", []
    if not w or not any(x in norm for x in licenses.GATE):
        return [], 0.0
    for r in licenses.rules():
        if " " + r["kw"] in norm:
            for m in re.finditer(r["rx"], norm, re.ASCII):
                s = norm[: m.start()].count(" ")
                found.append((s, s + m[0].count(" "), r))
    beats = lambda e, d: e is not d and e[0] <= d[0] and e[1] >= d[1] and (e[2]["priority"] > d[2]["priority"] or e[2]["priority"] == d[2]["priority"] and (e[1] - e[0] > d[1] - d[0] or e[2]["id"] < d[2]["id"]))
    stand = [d for d in found if d[2]["base"] or not any(beats(e, d) for e in found)]
    return sorted((s, e, r["label"]) for s, e, r in stand), max((r["confidence"] for _, _, r in stand), default=0.0)


def example(pattern, rng: random.Random) -> str:
    """A text that the pattern matches, its alternatives taken at random."""
    out = ""
    for op, arg in pattern:
        if op is C.LITERAL:
            out += chr(arg)
        elif op is C.BRANCH:
            out += example(rng.choice(arg[1]), rng)
        elif op is C.SUBPATTERN:
            out += example(arg[3], rng)
        elif op is C.MAX_REPEAT:
            out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        elif op is C.IN:
            kind, value = rng.choice(arg)
            out += chr(value) if kind is C.LITERAL else chr(rng.randint(*value)) if kind is C.RANGE else "7" if value is C.CATEGORY_DIGIT else "x"
        else:
            raise ValueError(op)
    return out


def got(spark, texts: list) -> list:
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], SCHEMA)
    return sorted(licenses.scan(docs).collect(), key=lambda r: r.doc_id)


def test_documents(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = queries.op10_license_scan(spark, data).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        labels = r.labels.split(",") if r.labels else []
        assert set(filter(None, r.base_labels.split(","))) <= set(labels) == set(labels) and labels == sorted(set(labels)) and 0 <= r.score <= 1


def test_base_places(spark):
    texts = [None, "", " -- ", "Under the MIT License", "x under-the\nmit  license. CC BY-NC cc by nc; apache license, version 2.0", "under the mit license under the mit license", "apache license version 20", "under the mit licenses", "cc by nc " * 4000, "éunder the mit license", "cc\x00by\x7fnc"]
    for r, t in zip(got(spark, texts), texts, strict=True):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)


def test_rules_and_suppression(spark):
    cases = {
        "SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
        "Licensed under the Apache License, Version 2.0 (the License)": "apache-2",
        "released under the GNU General Public License version 3": "gpl-3.0",
        "released under the GNU Lesser General Public License, version 2.1": "lgpl-2.1",
        "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "https://creativecommons.org/publicdomain/zero/1.0/": "cc0-1.0",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "This is in the public domain": "public-domain",
        "the weather was fine and nobody spoke of law": "",
        "a license to print money": "",
    }
    for r, (text, want) in zip(got(spark, list(cases)), cases.items(), strict=True):
        assert r.labels == want, text
        assert (r.score > 0) == bool(want)


def test_every_rule_passes_its_keyword_and_the_gate():
    rng = random.Random(1)
    for r in licenses.rules():
        for _ in range(40):
            text = " " + example(_parser.parse(r["rx"][4:-6]), rng) + " "
            assert re.search(r["rx"], text, re.ASCII) and " " + r["kw"] in text and any(x in text for x in licenses.GATE), (r["rx"], text)


def test_same_as_a_plain_version(spark, data):
    """Documents, and texts of many rules' examples run into one another, against all rules and all pairs of places."""
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    patterns = [_parser.parse(r["rx"][4:-6]) for r in licenses.rules()]
    texts += [" ".join(example(rng.choice(patterns), rng) if rng.random() < 0.8 else "and so" for _ in range(n)) for n in [1] * 60 + [3] * 60 + [40] * 10 + [200]]
    texts += [" ".join(example(p, rng) for p in patterns)]
    for r, t in zip(got(spark, texts), texts, strict=True):
        stand, score = twin(t)
        assert sorted((d.s, d.e, d.label) for d in r.detections) == stand, t[:200]
        assert r.labels == ",".join(sorted({x for _, _, x in stand})) and r.score == pytest.approx(score)


def test_detections_tell_where(spark):
    r, = got(spark, ["one two licensed under the mit license now"])
    assert [(d.s, d.e, d.label) for d in r.detections if d.base] == [(3, 7, "mit")]


def test_there_are_hundreds_of_rules_in_order():
    table = licenses.rules()
    assert len(table) > 300 and [r["id"] for r in table] == list(range(len(table)))
    assert all(a["priority"] >= b["priority"] for a, b in zip(table, table[1:], strict=False)) and table[0]["base"]


def test_native_and_empty(spark, data):
    plan = queries.op10_license_scan(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
