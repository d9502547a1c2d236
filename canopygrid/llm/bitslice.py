"""Bit-sliced Hamming comparison: planes of up to 64 fingerprints per word, distances kept in carry-save counters."""

from __future__ import annotations

import numpy as np

LANES = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
ONE = np.uint64(1)


class Planes:
    """Fingerprints in groups, stored vertically.

    Each group's rows fill blocks of 64 lanes; word ``k`` of a block holds bit ``k`` of its 64 fingerprints.
    """

    def __init__(self, prints: np.ndarray, group: np.ndarray):
        """``prints``: (rows, bits / 64) uint64; ``group``: ascending group number of each row."""
        self.prints, n = prints, len(group)
        self.bits = prints.shape[1] * 64
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[first, n])
        at = np.arange(n) - np.repeat(first, size)
        self.lane = at % LANES
        blocks = -(-size // LANES)
        self.group_end = np.repeat(np.cumsum(blocks), size)
        self.block = np.repeat(np.cumsum(blocks) - blocks, size) + at // LANES
        self.start = np.flatnonzero(self.lane == 0)
        lane = self.lane.astype(np.uint64)
        self.words = np.empty((self.bits, len(self.start)), np.uint64)
        for k in range(self.bits):
            bit = (prints[:, k // 64] >> np.uint64(k % 64)) & ONE
            self.words[k] = np.bitwise_or.reduceat(bit << lane, self.start)
        self.valid = np.bitwise_or.reduceat(ONE << lane, self.start)

    def near(self, radius: int, most: int = 1 << 17):
        """Yield arrays (i, j), i < j, of rows of one group whose fingerprints differ in at most ``radius`` bits.

        ``most``: rows-times-blocks compared at once, which bounds the memory.
        """
        todo = self.group_end - self.block
        ends = np.cumsum(todo)
        low = 0
        while low < len(todo):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + most, "right")))
            reps = todo[low:high]
            row = np.repeat(np.arange(low, high), reps)
            step = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
            yield from self._compare(row, self.block[row] + step, radius)
            low = high

    def _compare(self, row: np.ndarray, block: np.ndarray, radius: int):
        own = block == self.block[row]
        # Lanes at or before the row's own one in its own block are none of its business, nor are empty lanes.
        after = np.where(own, ~((ONE << self.lane[row].astype(np.uint64)) | ((ONE << self.lane[row].astype(np.uint64)) - ONE)), FULL)
        over = ~(self.valid[block] & after)
        depth = max(1, int(radius).bit_length())
        # Counters start so that radius + 1 overflows them.
        offset = (1 << depth) - 1 - radius
        counters = [np.full(len(row), FULL if offset >> c & 1 else 0, np.uint64) for c in range(depth)]
        for k in range(self.bits):
            if k % 8 == 0:
                alive = over != FULL
                left = int(alive.sum())
                if not left:
                    return
                if left < 0.8 * len(row):
                    row, block, over = row[alive], block[alive], over[alive]
                    counters = [c[alive] for c in counters]
            mine = np.uint64(0) - ((self.prints[row, k // 64] >> np.uint64(k % 64)) & ONE)
            carry = self.words[k][block] ^ mine
            for c in counters:
                held = c & carry
                c ^= carry
                carry = held
            over |= carry
        hit = ~over
        some = np.flatnonzero(hit)
        if len(some):
            which, lane = np.nonzero(np.unpackbits(hit[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[some[which]], self.start[block[some[which]]] + lane


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Join the labels of linked rows; each row's label is the smallest row number that it reaches."""
    while True:
        low = np.minimum(labels[i], labels[j])
        apart = labels[i] != labels[j]
        if not apart.any():
            return labels
        i, j, low = i[apart], j[apart], low[apart]
        np.minimum.at(labels, labels[i], low)
        np.minimum.at(labels, labels[j], low)
        while True:
            jump = labels[labels]
            if (jump == labels).all():
                break
            labels = jump
