"""Counting quotient filters over 64-bit fingerprints, kept in blocks that merge without loss."""

from __future__ import annotations

import numpy as np

#: Quotient bits inside a block, and the longest run that one entry tells (a longer one is several entries).
QUOTIENT_BITS, LONGEST_RUN = 10, (1 << 16) - 1


def _width(block_bits: int) -> int:
    """Bytes of a remainder."""
    return (64 - block_bits - QUOTIENT_BITS + 7) // 8


class Block:
    """The fingerprints that share their ``block_bits`` top bits, sorted: occupied quotients with the lengths of their runs,
    remainders, a bit for each that counts more than one, and those counts. So a fingerprint takes some ten bytes whether
    a block holds one or a million."""

    def __init__(self, quotients: np.ndarray, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.quotients, self.runs, self.remainders, self.counts = quotients, runs, remainders, counts

    def to_bytes(self, block_bits: int) -> bytes:
        more = self.counts > 1
        sizes = np.array([len(self.quotients), len(self.remainders)], "<u4")
        rest = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _width(block_bits)])
        parts = sizes, self.quotients.astype("<u2"), self.runs.astype("<u2"), rest, np.packbits(more), self.counts[more].astype("<u4")
        return b"".join(x.tobytes() for x in parts)

    @classmethod
    def from_bytes(cls, data: bytes, block_bits: int) -> Block:
        entries, n = np.frombuffer(data, "<u4", 2).tolist()
        quotients, runs = np.frombuffer(data, "<u2", 2 * entries, 8).reshape(2, -1)
        at, width = 8 + 4 * entries, _width(block_bits)
        rest = np.zeros((n, 8), np.uint8)
        rest[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        at += n * width
        more = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), count=n).astype(bool)
        counts = np.ones(n, np.int64)
        counts[more] = np.frombuffer(data, "<u4", int(more.sum()), at + (n + 7) // 8)
        return cls(quotients, runs, rest.reshape(-1).view("<u8"), counts)

    def fingerprints(self, block: int, block_bits: int) -> np.ndarray:
        low = np.uint64(64 - block_bits - QUOTIENT_BITS)
        return (np.uint64(block) << np.uint64(64 - block_bits)) | (np.repeat(self.quotients.astype(np.uint64), self.runs) << low) | self.remainders


def blocks(values: np.ndarray, block_bits: int):
    """(block, filter) for each block that the uint64 ``values`` touch."""
    found, counts = np.unique(values, return_counts=True)
    top = (found >> np.uint64(64 - block_bits)).astype(np.int64)
    low = np.uint64(64 - block_bits - QUOTIENT_BITS)
    rest = found & ((np.uint64(1) << low) - np.uint64(1))
    quotient = ((found >> low) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(found) else np.empty(0, np.int64)
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(found)], strict=True):
        q, run = np.unique(quotient[a:z], return_counts=True)
        n = -(-run // LONGEST_RUN)
        runs = np.full(int(n.sum()), LONGEST_RUN)
        runs[np.cumsum(n) - 1] = run - (n - 1) * LONGEST_RUN
        yield int(top[a]), Block(np.repeat(q, n), runs, rest[a:z], counts[a:z])


def merged(parts: list[bytes], block: int, block_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of several filters of one block, sorted, and their summed counts: what one filter of all would hold."""
    read = [Block.from_bytes(p, block_bits) for p in parts]
    values = np.concatenate([r.fingerprints(block, block_bits) for r in read])
    counts = np.concatenate([r.counts for r in read])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.add.reduceat(counts, first)
