"""Ranked lexical search: WAND over shards of documents, one heap an item and shard, heaps merged.

Tasks index their documents: for each the terms that the items ask for, and how often it has them. A task's shard turns
that into postings by term with the largest impact of each. For an item, terms whose largest impacts together stay below
what the heap's last document scores cannot bring in a document by themselves, so their postings are not walked. The
pivots, documents that hold another term and whose terms' largest impacts could beat the heap, are found for a stretch of
documents at a time; only these are looked up in the remaining postings, the strongest first, and left as soon as what is
still possible cannot beat the heap. The heap moves on from shard to shard of a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.llm.store import dropped, stored
from spreadloom.llm.textscan import Words, steps

#: Documents of an item's ranking.
TOP = 50
#: Items that are searched for at a time (more take further turns), and terms that their texts may add up to.
BLOCK_ITEMS, BLOCK_TERMS = 2000, 200_000
#: Postings of one shard, and documents of the first stretch that pivots are looked for in (each further one is twice as long)
#: and of the longest.
SHARD_POSTINGS, STRETCH, LONGEST = 4_000_000, 256, 4096
#: Parts that an item's shard heaps are first merged in.
MERGE_PARTS = 16
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """The terms of a text: ASCII letters and digits and all other characters, lower-cased in A-Z only."""
    return [t.lower() for t in _TERM.findall(text.encode())] if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Vocabulary:
    """The terms that items ask for, found in texts by hash and length."""

    def __init__(self, names: list[bytes]):
        whole = b" ".join(names)
        w = Words(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]), "alnum")
        h, size = w.hashes(), w.end - w.start
        order = np.argsort(h)
        self.hash, self.size, self.term = h[order], size[order], order

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position, term) of all words that are terms."""
        h = w.hashes()
        k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        at = np.flatnonzero((self.hash[k] == h) & (self.size[k] == w.end - w.start))
        return at, self.term[k[at]]


def indexed(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), and packed: the vocabulary's terms that the document has (32 bits each), then how
    often it has each (32 bits). Documents without a term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, buf, offs in steps(b.column(1)):
                w = Words(buf, offs, "alnum")
                at, term = shared.value.find(w)
                cell, tf = np.unique(w.rows_of(at) << 32 | term, return_counts=True)
                cuts = np.searchsorted(cell >> 32, np.arange(len(offs)))
                term, tf = (cell & 0xFFFFFFFF).astype("<u4"), tf.astype("<u4")
                has = np.flatnonzero(w.counts)
                packed = [term[x:y].tobytes() + tf[x:y].tobytes() for x, y in zip(cuts[has].tolist(), cuts[has + 1].tolist(), strict=True)]
                ids = b.column(0).slice(a, len(offs) - 1).take(pa.array(has))
                yield pa.RecordBatch.from_arrays([ids, pa.array(w.counts[has].astype(np.int64)), pa.array(packed, pa.binary())], ["doc_id", "n", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, "doc_id long, n long, packed binary")


def frequencies(index: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms with repeats, documents that hold each vocabulary term) of the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(size, np.int64), 0, 0
        for b in batches:
            n, total = n + b.num_rows, total + int(b.column(0).to_numpy().sum())
            for x in filter(None, b.column(1).to_pylist()):
                df[np.frombuffer(x, "<u4", len(x) // 8)] += 1
        if n:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], some)), pa.array(np.append([n, total], df[some]))], ["term", "n"])

    df = np.zeros(size + 2, np.int64)
    for r in index.select("n", "packed").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        df[r["term"]] = r["n"]
    return int(df[-1]), int(df[-2]), df[:size]


class Heap:
    """The best documents of an item so far: higher scores first, then smaller doc_ids."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a document has to score at least."""
        return int(self.score[-1]) if len(self.score) >= self.top else 1

    def open_to(self, most: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Whether documents that score at most so much may come in: equal scores go by doc_id."""
        last = self.doc[-1] if len(self.doc) >= self.top else 2**63 - 1
        return (most > self.least) | (most == self.least) & (doc <= last)

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.append(self.score, score), np.append(self.doc, doc)
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


class Shard:
    """Postings of some documents, by term: places of the documents in order, the impact in each, and the largest one."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, packed: list[bytes], weights: np.ndarray):
        n = np.array([len(x) // 8 for x in packed], np.int64)
        none = [np.empty(0, "<u4")]
        term = np.concatenate([np.frombuffer(x, "<u4", len(x) // 8) for x in packed if x] or none).astype(np.int64)
        tf = np.concatenate([np.frombuffer(x, "<u4", offset=len(x) // 2) for x in packed if x] or none).astype(np.int64)
        place = np.repeat(np.arange(len(n)), n)
        impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[place]))
        order = np.argsort(term, kind="stable")
        self.doc, self.place, self.impact = doc, place[order], impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, term, impact)

    def search(self, item: np.ndarray, heap: Heap) -> int:
        """Bring the item's best documents into the heap; the number of documents that were scored."""
        item = item[self.first[item + 1] > self.first[item]]
        item = item[np.argsort(-self.most[item], kind="stable")]
        most = self.most[item]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # the most that terms from one on can add
        lists = [(self.place[self.first[t] : self.first[t + 1]], self.impact[self.first[t] : self.first[t + 1]]) for t in item.tolist()]
        begin, length, scored = 0, STRETCH, 0
        while begin < len(self.doc) and rest[0] >= heap.least:
            end = min(len(self.doc), begin + length)
            walked = int(np.searchsorted(-rest, -heap.least, "right"))  # beyond these, terms alone stay below the heap
            sums = np.zeros(end - begin, np.int64)
            for k in range(walked):  # pivots: documents of the walked postings, with what their terms can add at most
                places = lists[k][0]
                lo, hi = np.searchsorted(places, (begin, end))
                sums[places[lo:hi] - begin] += most[k]
            pivot = np.flatnonzero((sums > 0) & (sums + rest[walked] >= heap.least))
            bound, score = sums[pivot] + rest[walked], np.zeros(len(pivot), np.int64)
            pivot = pivot + begin
            for k, (places, impacts) in enumerate(lists):
                if not len(pivot):
                    break
                at = np.minimum(np.searchsorted(places, pivot), len(places) - 1)
                own = np.where(places[at] == pivot, impacts[at], 0)
                score += own
                # The bound held the term's largest impact where the document has it, and for terms not walked always.
                bound += own - np.where(places[at] == pivot, most[k], 0) if k < walked else own - most[k]
                stays = heap.open_to(bound, self.doc[pivot])
                if not stays.all():
                    pivot, bound, score = pivot[stays], bound[stays], score[stays]
            good = score > 0
            heap.add(score[good], self.doc[pivot[good]])
            scored += len(pivot)
            begin, length = end, min(LONGEST, length * 2)
        return scored


def _ranked(index: DataFrame, wanted: list[np.ndarray], n_docs: int, total: int, df: np.ndarray, top: int) -> DataFrame:
    """item (place in ``wanted``), doc_id, score: the best documents of the whole index for each item."""
    weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((weights, wanted))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, wanted = shared.value
        heaps = [Heap(top) for _ in wanted]
        held: list[tuple] = []
        size = 0

        def close() -> None:
            doc, m, packed = (sum((x[k] for x in held), []) for k in range(3))
            shard = Shard(np.array(doc, np.int64), np.array(m, np.int64), packed, weights)
            for item, heap in zip(wanted, heaps, strict=True):
                shard.search(item, heap)

        for b in batches:
            ids = b.column(0).fill_null(2**63 - 1).to_pylist()
            m = [50 + 50 * n * n_docs // total for n in b.column(1).to_pylist()]
            packed = b.column(2).to_pylist()
            held.append((ids, m, packed))
            size += sum(map(len, packed)) // 8
            if size >= SHARD_POSTINGS:
                close()
                held, size = [], 0
        if held:
            close()
        n = [len(h.doc) for h in heaps]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n), dtype=np.int32), n)), *(pa.array(np.concatenate([getattr(h, c) for h in heaps])) for c in ("doc", "score"))], ["item", "doc_id", "score"])

    found = index.mapInArrow(search, "item int, doc_id long, score long")
    for by in (["item", F.pmod("doc_id", F.lit(MERGE_PARTS))], ["item"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return found


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, set[bytes]]]]:
    """The stated query set in blocks of bounded size: item ids with their terms."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        own = set(terms(r["text"]))
        if own:
            block.append((r["item_id"], own))
            size += len(own)
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_TERMS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` documents of each item, whole numbers all through.

    A null or empty text has no term: such a document is in no statistic and no result, such an item has no rows. Equal
    scores go by doc_id (null ones last); rows that repeat count, and rank, one by one. An item that repeats has its rows
    as often. Other columns are left out. The items are a stated query set and go out in blocks of bounded size.
    """
    spark, out = docs.sparkSession, []
    kind = items.schema["item_id"].dataType.simpleString()
    for block in _blocks(items):
        vocabulary = sorted(set().union(*(own for _, own in block)))
        place = {t: k for k, t in enumerate(vocabulary)}
        index = stored(indexed(docs, vocabulary), "search-index")
        n_docs, total, df = frequencies(index, len(vocabulary))
        if not total:
            continue
        wanted = [np.array(sorted(place[t] for t in own), np.int64) for _, own in block]
        found = stored(_ranked(index, wanted, n_docs, total, df, top), "search-found")
        dropped(index)
        names = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], f"item int, item_id {kind}")
        doc_id = F.when(F.col("doc_id") < 2**63 - 1, F.col("doc_id")).alias("doc_id")
        out.append(found.join(F.broadcast(names), "item").select("item_id", "rank", doc_id, "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    while len(out) > 1:
        out = [a.unionByName(b) for a, b in zip(out[::2], out[1::2], strict=False)] + out[len(out) & ~1 :]
    return out[0]
