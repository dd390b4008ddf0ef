"""Removal of repeated word passages, by suffix trees over prefix-partitioned word suffixes.

A suffix starts at each word; only its first ``width`` words matter, so a tree is cut at that depth. Three things keep the
work small and evenly spread:

* A window picks an anchor, the least of its short word runs by hash. Equal windows pick the same run, so a window whose
  anchor occurs once in the corpus is in no deep node and never leaves its task. Neighbouring windows mostly share an
  anchor and travel as one segment of words.
* A group of suffixes has the prefix of its anchor; where too many share that run, suffixes go by all of their words
  instead. Each group is built in memory: its suffixes are sorted by their words, common-prefix lengths of neighbours give
  the internal nodes, and each node as deep as a window has its first suffix and the later ones, which go. Hashes only
  pick groups; equality is on words.
* A task builds the tree of its own suffixes first and sends the first of each deep node only. So a passage that a third
  of all documents hold reaches its group once a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spreadloom.llm import cqf
from spreadloom.llm.store import dropped, small_side, stored
from spreadloom.llm.textscan import KINDS, Words, mix, steps

#: Words of a window and of an anchor's run.
WIDTH, RUN = 20, 8
#: Anchors and suffixes that a task holds before it hands them on, and bytes of text for each block of anchors and group of suffixes.
HELD, HELD_SUFFIXES, BLOCK_BYTES, GROUP_BYTES = 400_000, 100_000, 1 << 24, 1 << 22
#: The most bits of the filter of repeated anchors, as a power of two.
MOST_BITS = 30
#: An anchor is shared by too many if it has more than this many occurrences and one of this many of all.
CROWDED, CROWDED_PART = 2000, 1 << 16
#: Documents with a null doc_id come before all others, in the order of their texts' hashes.
NULL_ID, NULL_IDS = -(2**63), 1 << 61
#: Of rows that share a doc_id with different texts, the k-th one's words count from k times two to this.
ROW_BITS = 31


def _anchors(w: Words, h: np.ndarray, width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, the anchor of each, hashes of the runs at all words)."""
    n = len(h)
    at, _ = w.windows(h, width) if n >= width else (np.empty(0, np.int64), None)
    if not len(at):
        return at, at, np.empty(0, np.uint64)
    g = np.zeros(n - run + 1, np.uint64)
    pos, gh = w.windows(h, run)
    g[pos] = gh
    span = width - run + 1
    best, reach = np.arange(len(g)), 1
    while reach < span:
        step = min(reach, span - reach)
        left, right = best[: len(best) - step], best[step:]
        best, reach = np.where(g[left] <= g[right], left, right), reach + step
    return at, best[at], g


def _packed(group: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """(group, the bytes of its part of each column), groups in order."""
    order = np.argsort(group, kind="stable")
    group = group[order]
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, z in zip([0, *cuts], [*cuts, len(group)], strict=True):
        if z > a:
            yield int(group[a]), [c[order[a:z]].tobytes() for c in columns]


def _batch(rows: list[tuple[int, list[bytes]]], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g for g, _ in rows], pa.int32()), *(pa.array([c[k] for _, c in rows], pa.binary()) for k in range(n))], ["group", *(f"c{k}" for k in range(n))])


def _runs(did: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(did, start, length) of runs of neighbouring places."""
    order = np.lexsort((pos, did))
    did, pos = did[order], pos[order]
    fresh = np.concatenate([[True], (did[1:] != did[:-1]) | (pos[1:] > pos[:-1] + 1)]) if len(did) else np.empty(0, bool)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(did))[: len(first)] - 1
    return did[first], pos[first], pos[last] - pos[first] + 1


class Segments:
    """Stretches of words in which suffixes start: the words between single spaces, the document and word of the first
    suffix, and how many suffixes start one word after another."""

    def __init__(self, words: pa.Array, did: np.ndarray, start: np.ndarray, n: np.ndarray):
        self.words, self.did, self.start, self.n = words, did, start, n

    def subtree(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, which of its suffixes, whether it is later than the first one of its deep node) of each suffix."""
        lists = pc.split_pattern(self.words, b" ")
        rank = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.uint32)
        segment = np.repeat(np.arange(len(self.n)), self.n)
        nth = np.arange(len(segment)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        did, pos = self.did[segment], self.start[segment] + nth
        by_place = np.lexsort((pos, did))
        at = (lists.offsets.to_numpy()[segment] + nth)[by_place]
        words = rank[at[:, None] + np.arange(width)].astype(">u4" if len(rank) and rank.max() >= 1 << 16 else ">u2")
        order = np.argsort(np.ascontiguousarray(words).view(f"S{words.itemsize * width}").ravel(), kind="stable")
        words = words[order]
        depth = np.logical_and.accumulate(words[1:] == words[:-1], axis=1).sum(1)  # of the node above two neighbours
        order = by_place[order]
        head = np.maximum.accumulate(np.where(np.append(True, depth < width), np.arange(len(order)), 0)) if len(order) else order
        later = np.empty(len(order), bool)
        later[order] = (did[order] != did[order][head]) | (pos[order] != pos[order][head])
        return segment, nth, later

    def later(self, width: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(runs of later suffixes, and for each segment the first and last of its suffixes that are not; none: -1)."""
        segment, nth, later = self.subtree(width)
        first, last = np.full(len(self.n), 1 << 30), np.full(len(self.n), -1)
        np.minimum.at(first, segment[~later], nth[~later])
        np.maximum.at(last, segment[~later], nth[~later])
        return _runs(self.did[segment][later], (self.start[segment] + nth)[later]), first, last


class Filter:
    """A bitmap of hashes, of bounded size: what it lacks is surely absent; what it has may be."""

    def __init__(self, bits: int):
        self.shift, self.set = np.uint64(64 - bits), np.zeros(1 << max(0, bits - 3), np.uint8)

    def add(self, h: np.ndarray) -> None:
        at = h >> self.shift
        np.bitwise_or.at(self.set, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.set[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _repeated_anchors(docs: DataFrame, n_bytes: int, width: int, run: int) -> tuple[Filter, np.ndarray]:
    """A filter with all anchors that occur more than once, and the anchors that too many suffixes share.

    Each task counts its anchors in a counting quotient filter, whose blocks merge without loss. What reaches the driver
    is one bitmap of at most 2 ** MOST_BITS bits and at most CROWDED_PART anchors, however large the corpus. If more
    anchors repeat than the bitmap can tell apart, more windows go on to the subtrees and the result is the same.
    """
    bits = max(6, (n_bytes // BLOCK_BYTES).bit_length())

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        close = lambda: _batch([(g, [f.to_bytes(bits)]) for g, f in cqf.blocks(np.concatenate(held), bits)], 1)
        for b in batches:
            for _, buf, offs in steps(b.column(0)):
                w = Words(buf, offs, "space")
                h = w.hashes()
                at, anchor, g = _anchors(w, h, width, run)
                if not len(at):
                    continue
                held.append(mix(g[np.unique(anchor)]))  # an anchor is the least of several hashes; spread them evenly again
                size += len(held[-1])
                if size >= HELD:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        values, counts = cqf.merged(table["c0"].to_pylist(), group, bits)
        often = counts > 1
        return pa.table({"group": pa.array([group], pa.int32()), "hashes": [values[often].tobytes()], "counts": [counts[often].astype(np.int64).tobytes()], "n": [int(often.sum())], "total": [int(counts.sum())]})

    found = stored(docs.select("text").mapInArrow(find, "group int, c0 binary"), "passage-anchors")
    repeated = stored(found.groupBy("group").applyInArrow(merge, "group int, hashes binary, counts binary, n long, total long"), "passage-repeated")
    n, total = (x or 0 for x in repeated.agg(F.sum("n"), F.sum("total")).first())
    room = max(CROWDED, total // CROWDED_PART)
    size = min(MOST_BITS, max(20, (32 * n).bit_length()))
    known = Filter(size)
    cut = max(0, size - 3 - bits)  # a block's hashes share their top bits, so they fill one stretch of the bitmap

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = Filter(size - bits)
                h = np.frombuffer(x.as_buffer(), np.uint64)
                part.add(h << np.uint64(bits))
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([part.set.tobytes()], pa.binary())], ["group", "set"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, c in zip(b.column(0), b.column(1), strict=True):
                hot = np.frombuffer(h.as_buffer(), np.int64)[np.frombuffer(c.as_buffer(), np.int64) > room]
                yield pa.RecordBatch.from_arrays([pa.array(hot)], ["h"])

    for r in repeated.select("group", "hashes").mapInArrow(stretch, "group int, set binary").toLocalIterator():
        known.set[r["group"] << cut : (r["group"] + 1) << cut] = np.frombuffer(r["set"], np.uint8)
    crowded = repeated.select("hashes", "counts").mapInArrow(shared, "h long").toPandas()["h"].to_numpy().astype(np.int64).view(np.uint64)
    dropped(found, repeated)
    return known, np.sort(crowded)


def _later_windows(docs: DataFrame, anchors: Filter, crowded: np.ndarray, n_bytes: int, width: int, run: int) -> DataFrame:
    """(did, start, length): runs of window starts whose windows also start earlier, as a stored table."""
    parts = max(1, n_bytes // GROUP_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast((anchors, crowded))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, crowded = shared.value
        held: list[tuple] = []
        size = 0

        def close():
            group, words, did, start, n = (np.concatenate(x) for x in zip(*held, strict=True))
            (d, p, m), first, last = Segments(pa.array(words, pa.binary()), did, start, n).later(width)
            send = []
            for k in np.flatnonzero(last >= 0).tolist():  # what is left of each segment
                if first[k] or last[k] < n[k] - 1:
                    words[k] = b" ".join(words[k].split(b" ")[first[k] : last[k] + width])
                send.append(k)
            start, n = start + first, last - first + 1
            order = np.array(send, np.int64)[np.argsort(group[send], kind="stable")]
            cuts = np.flatnonzero(np.diff(group[order], prepend=-1)) if len(order) else order
            rows = [(int(group[order[a]]), [b"\n".join(words[order[a:z]]), did[order[a:z]].tobytes(), start[order[a:z]].astype(np.int64).tobytes(), n[order[a:z]].astype(np.int32).tobytes()]) for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            return _batch(rows + [(g, [b"", x, y, z]) for g, (x, y, z) in _packed(d % parts, d, p, m.astype(np.int32))], 4)

        for b in batches:
            ids, nth = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            for a, buf, offs in steps(b.column(2)):
                w = Words(buf, offs, "space")
                h = w.hashes()
                at, anchor, g = _anchors(w, h, width, run)
                if not len(at):
                    continue
                fresh = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)))
                fresh = fresh[anchors.has(mix(g[anchor[fresh]]))]
                if not len(fresh):
                    continue
                same = np.append(at[1:] == at[:-1] + 1, False) & np.append(anchor[1:] == anchor[:-1], False)
                ends = np.flatnonzero(~same)
                n = ends[np.searchsorted(ends, fresh)] - fresh + 1
                key = mix(g[anchor[fresh]])
                if len(crowded) and (hot := np.isin(key, crowded)).any():  # each suffix by itself
                    _, own = w.windows(h, width)
                    single = np.repeat(fresh[hot], n[hot]) + np.arange(int(n[hot].sum())) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
                    fresh, n, key = np.append(fresh[~hot], single), np.append(n[~hot], np.ones(len(single), np.int64)), np.append(key[~hot], own[single])
                begin, last = at[fresh], at[fresh] + n + width - 2
                lo, hi = w.start[begin], w.end[last]
                gaps, odd = (np.concatenate([[0], np.cumsum(x)]) for x in (~KINDS["space"][buf], ~KINDS["space"][buf] & (buf != 32)))
                plain = (gaps[hi] - gaps[lo] == n + width - 2) & (odd[hi] == odd[lo])
                raw = buf.tobytes()
                words = np.empty(len(n), object)
                words[:] = [raw[x:y] if ok else b" ".join(raw[x:y].split()) for x, y, ok in zip(lo.tolist(), hi.tolist(), plain.tolist(), strict=True)]
                row = w.rows_of(begin)
                held.append(((key >> np.uint64(20)) % np.uint64(parts), words, ids[a + row], (nth[a + row] << ROW_BITS) + begin - w.first[row], n))
                held[-1] = (held[-1][0].astype(np.int64), *held[-1][1:])
                size += int(n.sum())
                if size >= HELD_SUFFIXES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    def group(table: pa.Table) -> pa.Table:
        rows = list(zip(*(table[f"c{k}"].to_pylist() for k in range(4)), strict=True))
        out = []
        if new := [r for r in rows if r[0]]:
            words = pa.array([x for r in new for x in r[0].split(b"\n")], pa.binary())
            did, start, n = (np.frombuffer(b"".join(r[k] for r in new), t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int32)))
            out.append(Segments(words, did, start, n.astype(np.int64)).later(width)[0])
        out += [(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int64), np.frombuffer(r[3], np.int32)) for r in rows if not r[0]]
        did, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"did": did, "start": start.astype(np.int64), "length": n.astype(np.int32)})

    sent = docs.select("did", "nth", "text").mapInArrow(suffixes, "group int, c0 binary, c1 binary, c2 binary, c3 binary")
    found = sent.groupBy("group").applyInArrow(group, "did long, start long, length int")
    word = F.col("start").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    found = found.select("did", F.shiftright("start", ROW_BITS).alias("nth"), F.struct(word.alias("start"), "length").alias("run"))
    found = stored(found.groupBy("did", "nth").agg(F.collect_list("run").alias("runs")), "passage-runs")
    shared.destroy()
    return found


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``did`` and ``nth``, which order documents: doc_id, and where that repeats with different
    texts the place of the text among those by hash (else 0)."""
    of_null = F.lit(NULL_ID) + F.pmod(F.xxhash64("text"), F.lit(NULL_IDS))
    did = F.coalesce(F.col("doc_id").cast("long"), of_null)
    texts = docs.where("doc_id is not null").select(did.alias("did"), F.xxhash64("text").alias("th"))
    several = texts.groupBy("did").agg(F.countDistinct("th").alias("n")).where("n > 1")
    several = stored(several.select("did"), "passage-several")
    if several.isEmpty():
        return docs.withColumn("did", did).withColumn("nth", F.lit(0).cast("long"))
    rank = F.row_number().over(Window.partitionBy("did").orderBy("th")) - 1
    names = stored(texts.join(several, "did", "left_semi").distinct().withColumn("k", rank), "passage-names")
    named = docs.withColumn("d0", did).withColumn("th", F.xxhash64("text")).join(small_side(names.withColumnRenamed("did", "d0")), ["d0", "th"], "left")
    return named.select(*docs.columns, F.col("d0").alias("did"), F.coalesce("k", F.lit(0)).cast("long").alias("nth"))


def without_repeats(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text): each document without its repeated passages.

    Words are all but ASCII white space. A word goes if it is in a window of ``width`` words that also starts earlier: in
    a document with a smaller doc_id (null ones are the smallest, and as rows that share a doc_id they go by their texts'
    hashes; equal rows share what becomes of them) or earlier in the same one. Windows are judged on the input. A null, empty or
    short text loses nothing, each row gives one row, and other columns are left out.
    """
    docs = _keyed(docs.select("doc_id", "text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    run = min(RUN, width)
    per_doc = _later_windows(docs, *_repeated_anchors(docs, n_bytes, width, run), n_bytes, width, run)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                kept = words
                if runs:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for r in runs:
                        gone[r["start"]] += 1
                        gone[r["start"] + r["length"] - 1 + width] -= 1
                    kept = [x for x, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), *([whole.decode()] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=False))], names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    joined = docs.join(per_doc, ["did", "nth"], "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    return joined.mapInArrow(rest, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else ""))
