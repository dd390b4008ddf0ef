"""Words, word hashes and shingles of whole Arrow text columns, computed with numpy over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that one step works on (a longer text is a step of its own).
STEP_BYTES = 1 << 20

_rng = np.random.default_rng(20240607)
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64)]
_BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 40, dtype=np.uint64)]

_b = np.arange(256)
_UPPER = (_b >= 65) & (_b <= 90)
#: Which bytes belong to words: by letters and digits (A-Z count as a-z), or all but ASCII white space.
KINDS = {
    "alnum": (_b >= 48) & (_b <= 57) | _UPPER | (_b >= 97) & (_b <= 122) | (_b >= 128),
    "space": ~((_b == 32) | (_b >= 9) & (_b <= 13)),
}
_CODES = {"alnum": np.stack([t[np.where(_UPPER, _b + 32, _b)] for t in _BYTES]), "space": _BYTES}
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers.get(which, (np.empty(0, np.uint64),) * 2)
    if len(up) < n:
        size = max(n, STEP_BYTES + 1)
        make = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64))])
        up, down = _powers[which] = make(_BASES[which]), make(pow(_BASES[which], -1, 1 << 64))
        if size > 8 * STEP_BYTES:  # for one very long text only
            del _powers[which]
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)), offs


def steps(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows with about STEP_BYTES bytes each."""
    buf, offs = buffers(col)
    a, n = 0, len(offs) - 1
    while a < n:
        z = max(a + 1, int(np.searchsorted(offs, offs[a] + STEP_BYTES, "right")) - 1)
        yield a, buf[offs[a] : offs[z]], offs[a : z + 1] - offs[a]
        a = z


def byte_hashes(buf: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the ``width`` bytes from each place on (none for the last ``width - 1``)."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers_of(0, len(buf) + 1)
    p = np.empty(len(buf) + 1, np.uint64)
    p[0] = 0
    np.cumsum(_BYTES[0][buf] * up[: len(buf)], out=p[1:])
    h = p[width:] - p[:n]
    h *= down[:n]
    return mix(h)


class Words:
    """The words of some rows: byte ranges ``start`` to ``end``, and ``first``, each row's first word (and the total)."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, kind: str):
        inside = KINDS[kind][buf]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(buf):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
            cuts = offs[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(buf))]
            before[cuts] = False
            after[cuts - 1] = False
        self.buf, self.offs, self.kind = buf, offs, kind
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        up, down = _powers_of(which, len(self.buf) + 1)
        p = np.empty(len(self.buf) + 1, np.uint64)
        p[0] = 0
        np.cumsum(_CODES[self.kind][which][self.buf] * up[: len(self.buf)], out=p[1:])
        return mix((p[self.end] - p[self.start]) * down[self.start])

    def windows(self, hashes: np.ndarray, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(word position, hash) of all windows of ``width`` words inside one row, in order.

        ``short``: a row of fewer words, but not none, is one window.
        """
        n = len(hashes)
        left = np.repeat(self.first[1:], self.counts) - np.arange(n)
        at = np.flatnonzero(left >= width)
        total = np.zeros(max(0, n - width + 1), np.uint64)
        for j in range(width):
            total += hashes[j : n - width + 1 + j] * np.uint64(_MIX[j]) if len(total) else 0
        h = mix(total[at]) if len(at) else np.empty(0, np.uint64)
        if short and len(rows := np.flatnonzero((self.counts > 0) & (self.counts < width))):
            extra = np.zeros(len(rows), np.uint64)
            for j in range(width - 1):
                has = self.counts[rows] > j
                extra[has] += hashes[self.first[rows][has] + j] * np.uint64(_MIX[j])
            extra = mix(extra + self.counts[rows].astype(np.uint64))
            at = np.concatenate([at, self.first[rows]])
            h = np.concatenate([h, extra])
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order]
        return at, h

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        """The rows that word positions belong to."""
        return np.searchsorted(self.first, at, "right") - 1
