"""Removal of repeated byte passages by run-length compressed Burrows-Wheeler indexes.

Every window of ``width`` bytes has an anchor, the least of its byte runs by hash. Equal windows have equal anchors, so a
corpus parts into groups of stretches by anchor, each stretch being the text under neighbouring windows of one anchor.

* Stretches go by digest first, thirty-odd bytes each: equal ones answer for each other, and an anchor of which only one
  stretch is known needs no more. Copies inside a task send one of them.
* Only anchors with different stretches send bytes. A group builds one index of its different stretches: suffixes in order,
  the transform cut into runs, and the text places of each run's two ends. Matching statistics, how long the text from a
  place on matches some other place, follow from the run ends alone: where the letter before is the neighbour's too, a
  match is one shorter than that of the place before. They are streamed in text order, and places of a match as long as a
  window are marked.
* An anchor that too many different stretches share (a passage of a third of all documents, each with its own
  surroundings) has its windows anchored again by longer runs, up to the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spreadloom.llm.store import dropped, stored
from spreadloom.llm.substring import Filter
from spreadloom.llm.textscan import byte_hashes, mix, steps

#: Bytes of a window, and of the runs that anchor windows, level by level (the last one is the window).
WIDTH, RUNS = 400, (96, 300, 400)
#: One run in so many is looked at first when the least of a window's is sought.
SPARSE = 48
#: Windows that one stretch has at most, and different stretches that an anchor has at most before its windows go a level on.
MOST_WINDOWS, CROWDED = 4096, 3000
#: Stretches and bytes that a task holds before it hands them on; bytes of text for each group of digests and of stretches.
HELD, HELD_BYTES, DIGEST_BYTES, GROUP_BYTES = 200_000, 1 << 24, 1 << 24, 1 << 22
#: The most bits of the filters that tell tasks which anchors have different stretches, or too many.
MOST_BITS = 30
NULL_ID = -(2**63)
#: No byte of UTF-8; it parts stretches.
BREAK = 0xFF
ANSWERED, INNER = 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The places of a byte string in the order of its suffixes, by doubling what is known of those still equal."""
    n = len(text)
    key = np.ndarray((n,), ">u8", text.tobytes() + bytes(8), strides=(1,)).astype(np.uint64)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    fresh = np.append(True, key[1:] != key[:-1])[:n]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    # The end sorts before all bytes: it had counted as zeros.
    known, h = np.flatnonzero(~fresh | np.append(~fresh[1:], False)), 8
    if len(known):
        tail = sa[known] + 8 > n
        if tail.any():  # suffixes shorter than the first step: set right by length
            key2 = rank[sa[known]] << 32 | np.where(tail, n - sa[known], 9)
            order = np.argsort(key2, kind="stable")
            sa[known], key2 = sa[known][order], key2[order]
            head = np.append(True, key2[1:] != key2[:-1])
            rank[sa[known]] = known[np.maximum.accumulate(np.where(head, np.arange(len(known)), 0))]
            known = known[~head | np.append(~head[1:], False)]
    while len(known):
        p = sa[known]
        key2 = rank[p] << 32 | (rank[np.minimum(p + h, n)] + 1)
        order = np.argsort(key2)
        p, key2 = p[order], key2[order]
        sa[known] = p
        head = np.append(True, key2[1:] != key2[:-1])
        rank[p] = known[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))]
        known = known[~head | np.append(~head[1:], False)]
        h *= 2
    return sa


class RunIndex:
    """The Burrows-Wheeler transform of a byte string in runs: letter and length of each, and the places of its two ends."""

    def __init__(self, text: np.ndarray):
        self.text = text
        sa = suffix_array(text)
        letters = text[sa - 1]
        fresh = np.append(True, letters[1:] != letters[:-1])[: len(text)]
        start = np.flatnonzero(sa == 0)  # no letter stands before the first place: a run of its own
        fresh[start] = True
        fresh[start[start + 1 < len(text)] + 1] = True
        begin = np.flatnonzero(fresh)
        end = np.append(begin[1:], len(text))
        self.letter, self.length = letters[begin], end - begin
        self.first, self.last = sa[begin], sa[end - 1]

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many bytes are equal from places ``a`` and ``b`` on."""
        n = len(self.text)
        eight = np.ndarray((n + 1,), "<u8", self.text.tobytes() + bytes(8), strides=(1,))
        out, open_ = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(open_):
            x, y = a[open_] + out[open_], b[open_] + out[open_]
            diff = eight[x] ^ eight[y]
            low = diff & (~diff + np.uint64(1))
            same = np.where(diff == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            left = n - np.maximum(x, y)
            out[open_] += np.minimum(same, left)
            open_ = open_[(same == 8) & (left > 8)]
        return out

    def matching(self) -> np.ndarray:
        """For each place, how many bytes from there on also stand somewhere else."""
        n = len(self.text)
        length = self._common(self.last[:-1], self.first[1:])  # across two runs
        out = np.zeros(n, np.int64)
        at = np.arange(n)
        for sample, value in ((self.first, np.append(0, length)), (self.last, np.append(length, 0))):
            known, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
            known[sample], last[sample] = value, sample
            last = np.maximum.accumulate(last)
            np.maximum(out, known[last] - (at - last), out=out)
        return out


def _neighbour(pos: np.ndarray, h: np.ndarray, row: np.ndarray, span: int, step: int) -> np.ndarray:
    """For each place, the nearest one on a side, less than ``span`` off, that is taken before it in a shared window; or -1."""
    out, open_, d = np.full(len(pos), -1), np.arange(len(pos)), 0
    while len(open_):
        d += step
        other = open_ + d
        ok = (other >= 0) & (other < len(pos))
        open_, other = open_[ok], other[ok]
        near = (row[other] == row[open_]) & (np.abs(pos[other] - pos[open_]) < span)
        open_, other = open_[near], other[near]
        before = h[other] <= h[open_] if step < 0 else h[other] < h[open_]
        out[open_[before]] = pos[other[before]]
        open_ = open_[~before]
    return out


def stretches(buf: np.ndarray, offs: np.ndarray, width: int, run: int) -> tuple[np.ndarray, ...]:
    """(row, first window's start, windows, anchor, whether its anchor may stand in it twice) of all windows, in order."""
    none = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, bool))
    size, span = np.diff(offs), width - run + 1
    rows = np.flatnonzero(size >= width)
    if not len(rows):
        return none
    g = byte_hashes(buf, run)
    fits = np.zeros(len(buf) + 1, np.int8)
    np.add.at(fits, offs[rows], 1)
    np.add.at(fits, offs[rows + 1] - run + 1, -1)
    fits = np.cumsum(fits[: len(g)], dtype=np.int8) > 0
    mark = fits & (g < np.uint64(2**64 // SPARSE))
    # Where a window may have none of them, all of its runs count.
    pos = np.flatnonzero(mark)
    edge = np.sort(np.concatenate([pos, offs[rows] - 1, offs[rows + 1] - run + 1]), kind="stable")
    wide = np.flatnonzero(np.diff(edge) > span)
    n = edge[wide + 1] - edge[wide] - 1
    fill = np.repeat(edge[wide] + 1 - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    mark[fill[fill < len(g)]] = True
    pos = np.flatnonzero(mark & fits)
    h, row = g[pos], np.searchsorted(offs, pos, "right") - 1
    left, right = _neighbour(pos, h, row, span, -1), _neighbour(pos, h, row, span, 1)
    lo = np.maximum(np.maximum(left + 1, pos - span + 1), offs[row])
    hi = np.minimum(np.minimum(np.where(right < 0, len(buf), right - span), pos), offs[row + 1] - width)
    has = lo <= hi
    row, lo, hi, h = row[has], lo[has], hi[has], h[has]
    fresh = np.append(True, (row[1:] != row[:-1]) | (lo[1:] != hi[:-1] + 1) | (h[1:] != h[:-1]))[: len(row)]
    head = np.flatnonzero(fresh)
    inner = np.diff(np.append(head, len(row))) > 1
    row, lo, h = row[head], lo[head], h[head]
    n = hi[np.append(head[1:], len(hi))[: len(head)] - 1] - lo + 1
    if len(n) and n.max() > MOST_WINDOWS:  # many equal runs close together: cut
        pieces = -(-n // MOST_WINDOWS)
        k = np.repeat(np.arange(len(n)), pieces)
        nth = np.arange(len(k)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        row, h, inner, lo, n = row[k], h[k], inner[k], lo[k] + nth * MOST_WINDOWS, np.minimum(n[k] - nth * MOST_WINDOWS, MOST_WINDOWS)
    return row, lo, n, mix(h), inner  # the least of several hashes; spread them evenly again


def _within(cut: tuple[np.ndarray, ...], want: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches cut to the windows that are wanted."""
    row, lo, n, h, inner = cut
    k = np.repeat(np.arange(len(n)), n)
    at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    k, at = k[want[at]], at[want[at]]
    fresh = np.append(True, (k[1:] != k[:-1]) | (at[1:] != at[:-1] + 1))[: len(k)]
    head = np.flatnonzero(fresh)
    k, n = k[head], np.diff(np.append(head, len(at)))
    return row[k], at[head], n, h[k], inner[k]


def by_level(buf: np.ndarray, offs: np.ndarray, crowded: list[Filter], width: int, runs: tuple[int, ...]) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """(level, stretches) of all windows: those with a crowded anchor go a level on."""
    cut, want = stretches(buf, offs, width, runs[0]), None
    for level, full in enumerate([*crowded, None]):
        if full is None or not len(cut[0]):
            yield level, cut
            return
        hot = full.has(cut[3])
        yield level, tuple(x[~hot] for x in cut)
        want = np.zeros(len(buf) + 1, np.int32)
        np.add.at(want, cut[1][hot], 1)
        np.add.at(want, cut[1][hot] + cut[2][hot], -1)
        if not hot.any():
            return
        cut = _within(stretches(buf, offs, width, runs[level + 1]), np.cumsum(want)[:-1] > 0)


def _digests(raw: bytes, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    make = hashlib.blake2b
    whole = b"".join([make(raw[a : a + m], digest_size=16).digest() for a, m in zip(lo.tolist(), size.tolist(), strict=True)])
    return np.frombuffer(whole, "<u8").reshape(-1, 2)


_STRETCH = np.dtype([("anchor", "<u8"), ("x", "<u8"), ("y", "<u8"), ("d", "<i8"), ("th", "<i8"), ("start", "<i8"), ("n", "<i4"), ("flag", "i1")])
RUNS_SCHEMA = "kind int, d long, th long, start long, n long"


def _grouped(group: np.ndarray, items: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(group, kind="stable")
    group, items = group[order], items[order]
    cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    for a, z in zip(cuts.tolist(), np.append(cuts[1:], len(group)).tolist(), strict=False):
        yield int(group[a]), items[a:z]


def _classes(items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items by anchor and digest, the class of each, the size of its class; one that is answered counts as two)."""
    items = items[np.lexsort([items[c] for c in ("y", "x", "anchor")])]
    fresh = np.append(True, np.logical_or.reduce([items[c][1:] != items[c][:-1] for c in ("anchor", "x", "y")]))[: len(items)]
    of = np.cumsum(fresh) - 1
    return items, of, np.bincount(of, 1 + (items["flag"] & ANSWERED))[of] if len(of) else of


def _answers(items: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(items), np.int32)), *(pa.array(np.ascontiguousarray(items[c]).astype(np.int64)) for c in ("d", "th", "start", "n"))], ["kind", "d", "th", "start", "n"])


def _scan(batches: Iterator[pa.RecordBatch], crowded: list[Filter], width: int, runs: tuple[int, ...]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """(level, bytes, places in them, stretches without digest) of batches of d, th, text."""
    for b in batches:
        d, th = (b.column(k).to_numpy() for k in (0, 1))
        for a, buf, offs in steps(b.column(2)):
            raw = None
            for level, (row, lo, n, h, inner) in by_level(buf, offs, crowded, width, runs):
                if not len(row):
                    continue
                raw = raw or buf.tobytes()
                out = np.zeros(len(row), _STRETCH)
                out["anchor"], out["d"], out["th"], out["start"], out["n"], out["flag"] = h, d[a + row], th[a + row], lo - offs[row], n, inner * INNER
                yield level, raw, lo, out


def _survey(docs: DataFrame, crowded: list[Filter], n_bytes: int, width: int, runs: tuple[int, ...]) -> DataFrame:
    """The stretches of the level after ``crowded``, by digest, as a stored table.

    kind 0: a run of windows that stand elsewhere too (d, th, start, n). kind 1: an anchor (``d``) with different
    stretches. kind 2: one with too many.
    """
    parts, level, last = max(1, n_bytes // DIGEST_BYTES), len(crowded), len(crowded) == len(runs) - 1
    shared = docs.sparkSession.sparkContext.broadcast(crowded)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            items, of, n = _classes(np.concatenate(held))
            again, fresh = n > 1, np.append(True, of[1:] != of[:-1])
            send = items[fresh].copy()
            send["flag"] |= np.where(again[fresh], ANSWERED, 0).astype(np.int8)
            rows = [(g, x.tobytes(), b"") for g, x in _grouped((send["anchor"] % np.uint64(parts)).astype(np.int64), send)]
            rows += [(g, b"", x.tobytes()) for g, x in _grouped((items["d"] ^ items["th"])[again] % parts, items[again])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["group", "found", "answers"])

        for at, raw, lo, out in _scan(batches, shared.value, width, runs):
            if at < level:
                continue
            digest = _digests(raw, lo, out["n"].astype(np.int64) + width - 1)
            out["x"], out["y"] = digest[:, 0], digest[:, 1]
            held.append(out)
            size += len(out)
            if size >= HELD:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    def compare(table: pa.Table) -> pa.Table:
        items = np.frombuffer(b"".join(x for x in table["found"].to_pylist()), _STRETCH)
        answers = np.frombuffer(b"".join(x for x in table["answers"].to_pylist()), _STRETCH)
        items, of, n = _classes(items)
        answers = np.concatenate([answers, items[(n > 1) & (items["flag"] & ANSWERED == 0)]])
        names, at = np.unique(items["anchor"], return_index=True)
        different = of[np.append(at[1:], len(of)) - 1] - of[at] + 1 if len(of) else at
        inner = np.logical_or.reduceat(items["flag"] & INNER > 0, at) if len(of) else at > 0
        full = (different > CROWDED) & (not last)
        anchors = [names[full].view(np.int64), names[~full & ((different > 1) | inner)].view(np.int64)]
        none = [np.zeros(len(x), np.int64) for x in anchors]
        rows = [pa.table({"kind": np.full(len(x), k, np.int32), "d": x, "th": z, "start": z, "n": z}) for x, z, k in zip(anchors, none, (2, 1), strict=True)]
        return pa.concat_tables([pa.Table.from_batches([_answers(answers)]), *rows])

    sent = docs.mapInArrow(find, "group int, found binary, answers binary")
    out = stored(sent.groupBy("group").applyInArrow(compare, RUNS_SCHEMA), f"bytes-level{level}")
    shared.destroy()
    return out


def _filter(rows: DataFrame, kind: int) -> Filter | None:
    """A filter of the anchors of a kind: what it lacks is none of them. At most 2 ** MOST_BITS bits reach the driver."""
    anchors = rows.where(F.col("kind") == kind).select("d")
    n = anchors.count()
    if not n:
        return None
    size = min(MOST_BITS, max(20, (32 * n).bit_length()))
    high = min(8, size - 3)  # a part of the filter holds the hashes of the same top bits

    def part(key: tuple, table: pa.Table) -> pa.Table:
        out = Filter(size - high)
        out.add(table["d"].to_numpy().view(np.uint64) << np.uint64(high))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([out.set.tobytes()], pa.binary())})

    known, step = Filter(size), 1 << (size - 3 - high)
    # Partial filters a task and part would be united by the shuffle of distinct anchors anyway, as hashes are distinct.
    top = F.shiftrightunsigned("d", 64 - high).cast("int")
    for r in anchors.groupBy(top.alias("part")).applyInArrow(part, "part int, bits binary").toLocalIterator():
        known.set[r["part"] * step : (r["part"] + 1) * step] = np.frombuffer(r["bits"], np.uint8)
    return known


def _matched(docs: DataFrame, crowded: list[Filter], open_: list[Filter | None], n_bytes: int, width: int, runs: tuple[int, ...]) -> DataFrame:
    """Runs of windows (d, th, start, n) of stretches that differ but share windows, found in each group's index."""
    parts = max(1, n_bytes // GROUP_BYTES)
    shared = docs.sparkSession.sparkContext.broadcast((crowded, open_))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded, open_ = shared.value
        held: dict[tuple, list] = {}
        size = 0

        def close() -> pa.RecordBatch:
            items = np.concatenate([x[0] for x in held.values()])
            for x, k in zip(held.values(), range(len(items)), strict=True):
                items["flag"][k] |= x[2]
            texts = np.empty(len(items), object)
            texts[:] = [x[1] for x in held.values()]
            group = (items["anchor"] % np.uint64(parts)).astype(np.int64)
            rows = [(g, items[own].tobytes(), b"".join(texts[own])) for g, own in _grouped(group, np.arange(len(items)))]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], ["group", "found", "texts"])

        for level, raw, lo, out in _scan(batches, crowded, width, runs):
            if open_[level] is None:
                continue
            some = np.flatnonzero(open_[level].has(out["anchor"]))
            out, lo = out[some], lo[some]
            for k, (a, m) in enumerate(zip(lo.tolist(), (out["n"] + width - 1).tolist(), strict=True)):
                text = raw[a : a + m]
                key = (int(out["anchor"][k]), text)
                if key in held:
                    held[key][2] = ANSWERED  # by its digest
                else:
                    held[key] = [out[k : k + 1], text, 0]
                    size += m
            if size >= HELD_BYTES:
                yield close()
                held, size = {}, 0
        if held:
            yield close()

    def match(table: pa.Table) -> pa.Table:
        own: dict[bytes, list] = {}
        for found, texts in zip(table["found"].to_pylist(), table["texts"].to_pylist(), strict=True):
            at = 0
            for item in np.frombuffer(found, _STRETCH):
                z = at + int(item["n"]) + width - 1
                key = (int(item["anchor"]), texts[at:z])
                own[key] = [item, True] if key in own else [item, bool(item["flag"] & ANSWERED)]
                at = z
        items = np.array([x[0] for x in own.values()], _STRETCH)
        done = np.array([x[1] for x in own.values()])
        text = np.frombuffer(b"".join(k[1] + bytes([BREAK]) for k in own), np.uint8)
        n = items["n"].astype(np.int64)
        size = n + width
        begin = np.cumsum(size) - size
        long = np.append(RunIndex(text).matching() >= width, False)
        # Windows of stretches that have no equal: the others are answered by their digests.
        item = np.repeat(np.flatnonzero(~done), n[~done])
        at = np.arange(len(item)) - np.repeat(np.cumsum(n[~done]) - n[~done], n[~done])
        hit = long[begin[item] + at]
        item, at = item[hit], at[hit]
        head = np.flatnonzero(np.append(True, (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1))[: len(item)])
        out = items[item[head]]
        out["start"] += at[head]
        out["n"] = np.diff(np.append(head, len(item)))
        return pa.Table.from_batches([_answers(out)])

    sent = docs.mapInArrow(find, "group int, found binary, texts binary")
    out = stored(sent.groupBy("group").applyInArrow(match, RUNS_SCHEMA), "bytes-matched")
    shared.destroy()
    return out


def without_repeats(docs: DataFrame, width: int = WIDTH, runs: tuple[int, ...] = RUNS, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, bytes): each document without repeated bytes.

    A byte of a text in UTF-8 goes if it is in a string of ``width`` bytes that also starts anywhere else, in the same
    document or another. Strings are judged on the input, so all copies go, and may overlap. A null, empty or short text
    loses nothing; each row gives one row, rows that repeat count as places of their own, a null doc_id is one like others,
    and other columns are left out. Equal stretches are told by 128-bit digests within an anchor of 64 bits, all other
    matches by their bytes.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("d"), F.xxhash64("text").alias("th"), "text")
    thin = keyed.select("d", "th", "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    crowded, open_, surveys = [], [], []
    while True:
        surveys.append(_survey(thin, crowded, n_bytes, width, runs))
        open_.append(_filter(surveys[-1], 1))
        full = _filter(surveys[-1], 2)
        if full is None:
            break
        crowded.append(full)
    found = surveys + ([_matched(thin, crowded, open_, n_bytes, width, runs)] if any(open_) else [])
    every = found[0].where("kind = 0")
    for f in found[1:]:
        every = every.unionByName(f.where("kind = 0"))
    per_doc = stored(every.groupBy("d", "th").agg(F.collect_list(F.struct("start", "n")).alias("runs")), "bytes-runs")
    dropped(*found)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode()
                kept, n_spans, n = raw, 0, len(raw)
                if spans:
                    gone = np.zeros(n + 1, np.int64)
                    start, windows = (np.array([s[c] for s in spans], np.int64) for c in ("start", "n"))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + windows + width - 1, -1)
                    stays = np.cumsum(gone)[:-1] == 0
                    n_spans = int(np.count_nonzero(~stays & np.append(True, stays[:-1])))
                    kept = np.frombuffer(raw, np.uint8)[stays].tobytes()
                rows.append((n, n - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_text"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_text else [])]
    joined = keyed.join(per_doc, ["d", "th"], "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(rest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if with_text else ""))
