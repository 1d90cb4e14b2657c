"""Canonical length-limited Huffman codes in NumPy: package-merge lengths, bit packing, and table-driven decoding of many lanes at once."""

from __future__ import annotations

import numpy as np

#: Ids between two bit-offset checkpoints of a block.
LANE = 64


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths (uint8, 0 for unused ids) of at most limit bits, by package-merge. Default limit: 4 bits above the least possible, 16 at least."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    least = int(np.ceil(np.log2(len(used))))
    limit = max(16, least + 4) if limit is None else limit
    if limit < least:
        raise ValueError("too many ids for this limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    levels = []  # of each merge, which of its sorted items are packages
    packages = np.empty(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank >= n)
        merged = both[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_package in reversed(levels):
        chosen = is_package[:take]
        leaves = int((~chosen).sum())
        lengths[:leaves] += 1
        take = 2 * int(chosen.sum())
    out[order] = lengths
    return out


class Code:
    """The canonical code of given lengths: shorter codes first, ids ascending within a length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.bits = max(1, int(self.lengths.max(initial=0)))
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        span = 1 << (self.bits - self.lengths[order])
        begin = np.concatenate([[0], np.cumsum(span)])
        if begin[-1] > 1 << self.bits:
            raise ValueError("these lengths are no prefix code")
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[order] = (begin[:-1] >> (self.bits - self.lengths[order])).astype(np.uint64)
        self.table = np.zeros(1 << self.bits, np.uint32)
        self.steps = np.ones(1 << self.bits, np.int64)
        self.table[: begin[-1]] = np.repeat(order, span)
        self.steps[: begin[-1]] = np.repeat(self.lengths[order], span)

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bit stream, bits of each lane of LANE ids as uint16)."""
        sizes = self.lengths[ids]
        if not sizes.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(sizes)
        at = ends - sizes
        word, shift = at >> 5, (at & 31).astype(np.uint64)
        value = self.codes[ids] << (np.uint64(64) - sizes.astype(np.uint64) - shift)
        n = (int(ends[-1]) + 31 >> 5) + 1 if len(ids) else 0
        # code bits never overlap, so sums of parts are their union; a word's sum stays below 2**32 and exact
        words = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n] if n else np.zeros(0)
        marks = np.concatenate([[0], ends[LANE - 1 :: LANE], ends[-1:] if len(ids) % LANE else []]) if len(ids) else np.zeros(1)
        return words.astype(np.uint64).astype(">u4").tobytes(), np.diff(marks).astype(np.uint16)

    def unpack(self, stream: bytes, lanes: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a stream, LANE table steps for all lanes together."""
        words = np.concatenate([np.frombuffer(stream, ">u4").astype(np.uint64), np.zeros(LANE * self.bits // 32 + 2, np.uint64)])
        window = words[:-1] << np.uint64(32) | words[1:]
        at = np.concatenate([[0], np.cumsum(lanes.astype(np.int64))[:-1]]) if len(lanes) else np.zeros(0, np.int64)
        out = np.empty((len(lanes), LANE), np.uint32)
        down, mask = 64 - self.bits, np.uint64((1 << self.bits) - 1)
        for k in range(LANE):
            peek = window[at >> 5] >> (down - (at & 31)).astype(np.uint64) & mask
            out[:, k] = self.table[peek]
            at = at + self.steps[peek]
        return out.reshape(-1)[:n]
