"""Benchmark decontamination by Wu-Manber multi-pattern search over normalised text."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spreadloom.llm.arrow import with_columns_from_text
from spreadloom.llm.store import small_side, stored

#: Words of a window, bytes of a block, and patterns of one search (a larger benchmark takes more searches).
WINDOW, BLOCK, PASS_PATTERNS = 10, 8, 200_000
#: Windows sent out at a time: some 250 MB in each worker. A benchmark with more takes several scans of the documents.
SENT_PATTERNS = 1_000_000
#: Item texts gathered for one search are bounded by this many rows.
PASS_ITEMS = 20_000
#: The most bits of a shift table's index, and bytes of text that one of the places searched side by side starts after another.
MOST_BITS, STRETCH = 24, 256
#: Bytes of normalised text that are searched at a time (a longer text is searched by itself).
STEP_BYTES = 1 << 20
#: ASCII letters to lower case; digits and bytes of other characters stay; all else becomes a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z."""
    return text.encode().translate(NORMAL).split() if text else []


def windows(item: list[bytes], width: int = WINDOW) -> list[bytes]:
    """The windows of an item as searched for: words between single spaces, with one at either end."""
    return [b" " + b" ".join(item[k : k + width]) + b" " for k in range(max(1, len(item) - width + 1))] if item else []


class _Bytes:
    """A text whose runs of up to eight bytes can be read as numbers at any places."""

    def __init__(self, text: bytes):
        self.text = text
        self.eight = np.ndarray((len(text) + 1,), "<u8", text + bytes(8), strides=(1,))

    def at(self, place: np.ndarray, n: int) -> np.ndarray:
        return self.eight[place] & np.uint64((1 << (8 * n)) - 1)


class WuManber:
    """Finds all occurrences of many different byte strings.

    Patterns of like length form a family. In each, a table of fixed size tells by the hash of a block (the last bytes
    read) how far the search may move on without missing a pattern; where blocks share a place in the table, the
    shortest move holds. Where it says 0, the bucket of that suffix block (and of the first bytes before it) has the
    patterns to compare directly. Many places of a text are searched side by side.
    """

    def __init__(self, patterns: list[bytes], block: int = BLOCK):
        self.size = np.array([len(p) for p in patterns], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = _Bytes(b"".join(patterns))
        self.families = []
        kind = np.minimum(np.frexp(self.size)[1], 7)
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            m = int(self.size[own].min())
            b = min(block, m)
            bits = min(MOST_BITS, max(12, (4 * len(own) * (m - b + 1)).bit_length()))
            shift = np.full(1 << bits, min(255, m - b + 1), np.uint8)
            for j in range(b, m + 1):  # ever shorter moves, so the shortest stays
                shift[self._place(self.all.at(self.start[own] + j - b, b), bits)] = min(255, m - j)
            bucket = self._bucket(self.all, self.start[own], m, b)
            order = np.argsort(bucket, kind="stable")
            self.families.append((m, b, bits, shift, bucket[order], own[order]))

    @staticmethod
    def _place(block: np.ndarray, bits: int) -> np.ndarray:
        return (block * _ODD >> np.uint64(64 - bits)).astype(np.int64)

    @staticmethod
    def _bucket(text: _Bytes, start: np.ndarray, m: int, b: int) -> np.ndarray:
        return (text.at(start + m - b, b) * _ODD ^ text.at(start, b)) * _ODD

    def pattern(self, k: int) -> bytes:
        return self.all.text[self.start[k] : self.start[k] + self.size[k]]

    def search(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of each occurrence; occurrences may overlap."""
        read, found = _Bytes(text), []
        for m, b, bits, shift, bucket, own in self.families:
            at = np.arange(m, len(text) + 1, STRETCH)
            last, stops = np.minimum(at + STRETCH, len(text) + 1), []
            while len(at):
                move = shift[self._place(read.at(at - b, b), bits)]
                stops.append(at[move == 0])
                at = at + np.maximum(move, 1)
                more = at < last
                at, last = at[more], last[more]
            start = np.concatenate(stops) - m if stops else np.empty(0, np.int64)
            key = self._bucket(read, start, m, b)
            lo, hi = np.searchsorted(bucket, key, "left"), np.searchsorted(bucket, key, "right")
            n = hi - lo
            k = own[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
            start = np.repeat(start, n)
            same = np.array([text.startswith(self.pattern(p), s) for s, p in zip(start.tolist(), k.tolist(), strict=True)], bool)
            found.append((start[same], k[same]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _passes(items: DataFrame, width: int) -> Iterator[dict[bytes, set[str]]]:
    """The patterns of a stated query set, in blocks of bounded size: window -> ids of its items."""
    part = max(1, -(-items.count() // PASS_ITEMS))
    for k in range(part):
        rows = items.select(F.col("item_id").cast("string").alias("i"), "text")
        rows = rows.where(F.pmod(F.xxhash64("i", "text"), F.lit(part)) == k) if part > 1 else rows
        block = defaultdict(set)
        for r in rows.toLocalIterator():
            for w in windows(words(r["text"]), width):
                if len(block) >= PASS_PATTERNS and w not in block:
                    yield block
                    block = defaultdict(set)
                block[w].update([] if r["i"] is None else [r["i"]])
        yield block


def _sendings(items: DataFrame, width: int) -> Iterator[list[tuple[list[bytes], list[list[str]]]]]:
    """Blocks of patterns with the ids of each, as many at a time as are sent out together; at least one sending."""
    group, n = [], 0
    for block in _passes(items, width):
        if group and n + len(block) > SENT_PATTERNS:
            yield group
            group, n = [], 0
        if block:
            group.append((list(block), [sorted(x) for x in block.values()]))
            n += len(block)
    yield group


def _found(texts: list[bytes], searches: list[tuple[WuManber, np.ndarray, list[list[str]]]]) -> tuple[list, list, list]:
    """(words hit, ids found, spans) of some normalised texts."""
    offs = np.cumsum([0] + [len(t) + 1 for t in texts])
    whole = b"\n".join(texts)  # no pattern has this byte
    spaces = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    before = np.searchsorted(spaces, offs)
    ids, spans = [set() for _ in texts], [[] for _ in texts]
    hit = np.zeros(len(spaces) + 1, np.int32)
    for by, n_words, names in searches:
        start, k = by.search(whole)
        text, first = np.searchsorted(offs, start, "right") - 1, np.searchsorted(spaces, start)
        np.add.at(hit, first, 1)
        np.add.at(hit, first + n_words[k], -1)
        for t, p, a in zip(text.tolist(), k.tolist(), (first - before[text]).tolist(), strict=True):
            ids[t].update(names[p])
            spans[t] += (a, a + int(n_words[p]))
    total = np.concatenate([[0], np.cumsum(np.cumsum(hit) > 0)])
    return (total[before[1:]] - total[before[:-1]]).tolist(), [sorted(x) for x in ids], spans


def _searched(docs: DataFrame, carry: list[str], shared: Broadcast) -> DataFrame:
    """``carry``, n_words, n_hit, __found and spans of each document, from the windows of one sending."""

    def make():
        searches = [(WuManber(p), np.array([x.count(b" ") - 1 for x in p], np.int64), names) for p, names in shared.value]

        def run(col: pa.Array) -> list:
            count, out, held, size = [], ([], [], []), [], 0

            def close():
                for to, got in zip(out, _found(held, searches), strict=True):
                    to.extend(got)

            for s in col:
                w = words(s.as_py())
                count.append(len(w))
                held.append(b" " + b" ".join(w) + b" " if w else b"")
                size += len(held[-1])
                if size >= STEP_BYTES:
                    close()
                    held, size = [], 0
            close()
            return [count, *out]

        return run

    new = T.StructType().add("n_words", T.LongType()).add("n_hit", T.LongType()).add("__found", T.ArrayType(T.StringType())).add("spans", T.ArrayType(T.IntegerType()))
    return with_columns_from_text(docs, carry, new, make)


def _joined(made: DataFrame, earlier: list[DataFrame]) -> DataFrame:
    """``made`` of the last sending with what the earlier ones found in the same texts."""
    both = earlier[0]
    for more in earlier[1:]:
        both = both.unionByName(more)
    all_of = lambda c: F.flatten(F.collect_list(c))
    found = stored(both.groupBy("__text").agg(all_of("__found").alias("__f"), all_of("spans").alias("__s")), "leaks")
    out = made.join(small_side(found), "__text", "left")
    none = lambda c: F.coalesce(c, F.array())
    out = out.withColumn("__found", F.array_sort(F.array_union("__found", none("__f")))).withColumn("spans", F.concat("spans", none("__s")))
    # Words inside any span: in order of their starts, each adds what stands beyond the ends so far.
    n = (F.size("spans") / 2).cast("int")
    ends = F.array_sort(F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(F.get("spans", 2 * k).alias("a"), F.get("spans", 2 * k + 1).alias("b"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    add = lambda acc, p: F.struct((acc["n"] + F.greatest(p["b"] - F.greatest(p["a"], acc["end"]), F.lit(0))).alias("n"), F.greatest(acc["end"], p["b"]).alias("end"))
    return out.withColumn("n_hit", F.aggregate(ends, start, add, lambda acc: acc["n"].cast("long"))).drop("__text", "__f", "__s")


def hits(docs: DataFrame, items: DataFrame, carry: tuple[str, ...] = ("doc_id",), width: int = WINDOW) -> DataFrame:
    """For each document: words, words inside any occurrence of an item's window, and the items found.

    Adds n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids), contaminated and spans (start and
    end words of the occurrences, in pairs). A null or empty text has no words and is clean; an item with a null
    id is searched for but gives no id, a null or empty item text has no windows; repeated rows and items count once each; empty
    tables are allowed on either side. The items are a stated query set. Up to ``SENT_PATTERNS`` windows are sent out at a
    time, and a task searches its texts for them without a shuffle. Of a larger benchmark all sendings but the last are a
    scan of their own, whose hits are stored by text and joined with those of the last: a worker's memory has a bound, and
    the scans grow with the items.
    """
    context, earlier, waiting = docs.sparkSession.sparkContext, [], None
    for blocks in _sendings(items, width):
        if waiting is not None:
            docs = docs.withColumn("__text", F.sha2(F.col("text").cast("binary"), 256)) if not earlier else docs
            shared = context.broadcast(waiting)
            hit = _searched(docs, ["__text"], shared).where("n_hit > 0")
            earlier.append(stored(hit.groupBy("__text").agg(F.first("__found").alias("__found"), F.first("spans").alias("spans")), "leaks-part"))
            shared.destroy()
        waiting = blocks
    own = [c for c in carry if c not in ("n_items", "items_sha256", "contaminated")]
    made = _searched(docs, own + ["__text"] * bool(earlier), context.broadcast(waiting))
    made = _joined(made, earlier) if earlier else made
    own = [c for c in made.columns if c not in ("n_words", "n_hit", "__found", "spans")]
    return made.select(
        *own, "n_words", "n_hit", F.size("__found").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "__found").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def decontaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents in which no window of an item occurs, with the columns that ``docs`` has."""
    own = [f"__c{k}" for k in range(len(docs.columns))]
    named = docs.toDF(*own).withColumn("text", F.col(own[docs.columns.index("text")]))
    return hits(named, items, tuple(own), width).where("not contaminated").select(own).toDF(*docs.columns)
