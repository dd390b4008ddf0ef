"""Filter interaction audit: what each order of five document filters removes at each step.

A document fails some of the filters, which is one of 32 sets. A fixed table of 32 sets by 120 orders tells the step at
which an order removes such a document. Tasks look their documents up in it and count removals by part, order, step and
label; what Spark sums are these partial counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.llm.arrow import with_columns_from_text
from spreadloom.llm.store import stored
from spreadloom.llm.textscan import Words, steps

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Of each order, the filters by step.
PLACES = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
#: Whether a set of failures (bit k: filter k) has each filter.
FAILS = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS))) & 1 > 0
#: The step (from 0) at which an order removes a document with a set of failures; as many as there are filters: it stays.
_failing = FAILS[:, PLACES]
FIRST = np.where(_failing.any(2), _failing.argmax(2), len(FILTERS)).astype(np.int64)

#: Fewest words, least share of distinct words and most capitals in a hundred code points.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SYMBOLS = b"#$%&*|"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 200
MEASURES = ("reached", "removed", "failing", "unique_fails", "good_lost", "toxic_lost")


def _sums(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each row have the flag."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def own_failures(col: pa.Array) -> np.ndarray:
    """For each text, the set of failures of the four filters that look at one text alone."""
    out = np.empty(len(col), np.int64)
    for a, buf, offs in steps(col):
        w = Words(buf, offs, "space")
        n = w.counts
        row, h = np.repeat(np.arange(len(n)), n), w.hashes()
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        fresh = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))[: len(row)]
        distinct = np.bincount(row[fresh], minlength=len(n))
        capitals, points = _sums((buf >= 65) & (buf <= 90), offs), _sums(buf & 0xC0 != 0x80, offs)
        fails = (n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * capitals > MOST_CAPITALS * points, _sums(_SYMBOL[buf], offs) > 0)
        out[a : a + len(n)] = sum(f.astype(np.int64) << k for k, f in enumerate(fails))
    return out


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, mask, n: how many documents of a part and of labels have a set of failures.

    Texts never move: a thin row tells a document's own failures and its text's digest. A document fails E unless its
    doc_id is the smallest of its text, so rows that repeat a doc_id fail or pass together; a null doc_id is neither
    smaller nor larger than any. Only one row for each text and doc_id, and after that one for each text, is shuffled.
    """
    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part, F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    thin = with_columns_from_text(docs, ["doc_id", "part", "digest"], T.StructType().add("mask", T.LongType()), lambda: lambda col: [own_failures(col)])
    some = lambda name: F.max(F.coalesce(F.col(name) == 1, F.lit(False))).alias(name)
    labelled = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(some("quality"), some("toxic"))
    rows = thin.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")).join(labelled, "doc_id", "left")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)).alias(name)
    rows = stored(rows.select("doc_id", "digest", "part", "mask", flag("quality"), flag("toxic"), "n"), "audit-rows")
    # All rows count as failing E; the first row of each text, and rows without doc_id, are then moved.
    e = 1 << FILTERS.index("E")
    kind = ["part", "quality", "toxic", "mask"]
    same = rows.groupBy("digest", "doc_id").agg(F.collect_list(F.struct(*kind, "n")).alias("rows"))
    first = same.where("doc_id is not null").groupBy("digest").agg(F.min_by("rows", "doc_id").alias("rows"))
    passing = first.select(F.inline("rows")).unionByName(rows.where("doc_id is null").select(*kind, "n"))
    moved = passing.select(F.explode(F.array(F.struct(*kind, "n"), F.struct(*kind[:3], (F.col("mask") + e).alias("mask"), (-F.col("n")).alias("n")))).alias("r")).select("r.*")
    return rows.select(*kind[:3], (F.col("mask") + e).alias("mask"), "n").unionByName(moved)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's documents by part, order and step."""
    size, wide = FIRST.shape[1] * len(FILTERS), len(FILTERS)
    at = np.arange(FIRST.shape[1])[:, None] * wide + np.arange(wide)
    held: dict[str, np.ndarray] = {}

    def close() -> pa.RecordBatch:
        parts = list(held)
        sums = np.concatenate([held[p] for p in parts], axis=1)
        columns = [pa.array(np.repeat(np.array(parts, object), size), pa.string()), pa.array(np.tile(np.arange(size, dtype=np.int32), len(parts)))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(s.astype(np.int64)) for s in sums)], ["part", "at", *MEASURES])

    for b in batches:
        named = b.column("part").dictionary_encode()
        part, names = named.indices.to_numpy(), named.dictionary.to_pylist()
        good, toxic, mask, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("quality", "toxic", "mask", "n"))
        # One cell for each part, set of failures and labels that the batch has.
        cell, of = np.unique(((part.astype(np.int64) * 2 + good) * 2 + toxic) * 32 + mask, return_inverse=True)
        n = np.bincount(of, n, len(cell)).astype(np.int64)
        mask, toxic, good, part = cell % 32, cell // 32 % 2, cell // 64 % 2, cell // 128
        step = FIRST[mask]  # one row a cell, one column an order
        gone = step < wide
        where = (part[:, None] * size + np.arange(step.shape[1]) * wide + np.minimum(step, wide - 1)).ravel()
        add = lambda index, weight: np.bincount(index.ravel(), weight.ravel(), len(names) * size)
        lost = lambda weight: add(where, np.where(gone, weight[:, None], 0))
        every = part[:, None, None] * size + at
        reached = add(every, n[:, None, None] * (step[:, :, None] >= np.arange(wide)))
        failing = add(every, n[:, None, None] * FAILS[mask][:, PLACES])
        alone = add(every, n[:, None, None] * (FAILS[mask][:, PLACES] & (FAILS[mask].sum(1) == 1)[:, None, None]))
        sums = np.stack([reached, lost(n), failing, alone, lost(n * good), lost(n * toxic)]).round().astype(np.int64)
        for k, name in enumerate(names):
            own = sums[:, k * size : (k + 1) * size]
            held[name] = held[name] + own if name in held else own
        if len(held) > HELD_PARTS:
            yield close()
            held.clear()
    if held:
        yield close()


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the five filters and step: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    Filters: A: under 200 words; B: less than half of the words distinct; C: more than 3 capitals A-Z in 100 code points;
    D: any of ``#$%&*|``; E: a smaller doc_id has the same text. A null text is empty (it fails A alone, and E where
    another comes first); a null lang is the part of the empty string; a document without a label, or with null ones,
    is neither good nor toxic; of repeated labels any 1 counts. Other columns are left out; an empty table has no part.
    """
    counted = failures(docs, labels).mapInArrow(_count, "part string, at int, " + ", ".join(f"{m} long" for m in MEASURES))
    sums = counted.groupBy("part", "at").agg(*(F.sum(m).alias(m) for m in MEASURES))
    wide = len(FILTERS)
    of = lambda values, index: F.element_at(F.array(*map(F.lit, values)), index + 1)
    name, step = of(ORDERS, F.floor(F.col("at") / wide).cast("int")), (F.col("at") % wide).cast("int")
    rows = sums.withColumn("filter_order", name).withColumn("step", step + 1).withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    rows = rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))
    kept: Column = F.col("reached") - F.col("removed")
    redundant = F.col("failing") - F.col("removed")
    return rows.select("part", "filter_order", "step", kept.alias("kept"), "removed", redundant.alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")
