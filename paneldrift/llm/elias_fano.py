"""Tries over sorted integer tuples in Elias-Fano levels: flat buffers, read in place."""

from __future__ import annotations

import mmap

import numpy as np

#: A low part is read through a window of 64 bits at a bit offset of at most 7.
MOST_LOW_BITS = 56
CODES_PER_DECADE = 3000
MOST_CODE = 65535
#: Values that are packed, and tuples that are looked up, at once: a bound on memory.
SLICE = 1 << 15


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes 1 to 65535 of probabilities: -log10 in steps of 1/3000. Code 0 is left for 'none'."""
    return np.clip(np.rint(-np.log10(p) * CODES_PER_DECADE) + 1, 1, MOST_CODE).astype(np.uint16)


def log10_of(codes: np.ndarray) -> np.ndarray:
    return (1.0 - codes.astype(np.float64)) / CODES_PER_DECADE


class Sequence:
    """A non-decreasing sequence of integers below 2^63 in Elias-Fano form.

    A value's low bits are packed; its high part h is the 1 at place h + i of a bit vector, i being its
    place in the sequence. The two buffers are all that is stored. Opening finds the ones and zeros of the
    vector, so that any value and the values with a given high part are found directly.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        bits = np.unpackbits(high, bitorder="little")
        self.ones, self.zeros = np.flatnonzero(bits), np.flatnonzero(bits == 0)
        #: The 64 bits from each byte on, as a view.
        self.windows = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray) -> Sequence:
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = min(max((top // max(n, 1)).bit_length() - 1, 0), MOST_LOW_BITS)
        values = values.astype(np.int64)
        high = np.zeros((top >> low_bits) + n + 8 & ~7, np.uint8)
        high[(values >> low_bits) + np.arange(n)] = 1
        low = np.zeros(0, np.uint8)
        if low_bits:
            packed = []
            # whole bytes at the end of each slice, as SLICE is a multiple of eight
            for i in range(0, n, SLICE):
                part = values[i : i + SLICE]
                bits = np.zeros((len(part), low_bits), np.uint8)
                for b in range(low_bits):
                    bits[:, b] = part >> b & 1
                packed.append(np.packbits(bits.ravel(), bitorder="little"))
            low = np.concatenate([low, *packed])
        return cls(n, low_bits, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(high, bitorder="little"))

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(at), np.int64)
        bit = at * self.low_bits
        return (self.windows[bit >> 3] >> (bit & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.ones[at] - at << self.low_bits) | self._low(at)

    def _below(self, high: np.ndarray) -> np.ndarray:
        """How many values have a smaller high part."""
        inside = np.clip(high - 1, 0, len(self.zeros) - 1)
        return np.where(high <= 0, 0, np.where(high > len(self.zeros), self.n, self.zeros[inside] - inside))

    def successor(self, first: np.ndarray, last: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The first place in [first, last) whose value is at least x, or last."""
        high = x >> self.low_bits
        lo = np.clip(self._below(high), first, last)
        hi = np.clip(self._below(high + 1), lo, last)
        low = x & (1 << self.low_bits) - 1
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = lo[live] + hi[live] >> 1
            less = self._low(mid) < low[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        return lo

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<i8").view(np.uint8), self.low, self.high]

    @classmethod
    def read(cls, buffer: np.ndarray, at: int) -> tuple[Sequence, int]:
        n, low_bits, low, high = (int(v) for v in np.frombuffer(buffer[at : at + 32].tobytes(), "<i8"))
        at += 32
        return cls(n, low_bits, buffer[at : at + low], buffer[at + low : at + low + high]), at + low + high


class Trie:
    """Sorted, different tuples with a 32-bit code each, such as the rank of a count.

    The first level holds the different first items. A later level holds the successors of every node
    of the level above it, in order; its pointers say where a node's successors begin. Successors are
    stored relative to their context: as the item plus the last value of the context before, which
    keeps the whole level monotone, and are found by a successor search in the context's range.
    """

    def __init__(self, levels: list[Sequence], pointers: list[Sequence], codes: np.ndarray) -> None:
        self.levels, self.pointers, self.codes = levels, pointers, codes

    @classmethod
    def of(cls, columns: list[np.ndarray], codes: np.ndarray) -> Trie:
        n = len(codes)
        levels, pointers = [], []
        new = np.zeros(n, bool)
        new[:1] = True
        parent = np.zeros(n, np.int64)
        for k, column in enumerate(columns):
            new = new.copy()
            new[1:] |= column[1:] != column[:-1]
            rows = np.flatnonzero(new)
            items, above = column[rows].astype(np.int64), parent[rows]
            if k == 0:
                levels.append(Sequence.of(items))
            else:
                starts = np.searchsorted(above, np.arange(levels[-1].n + 1))
                # the last items of the contexts before, added up
                base = np.concatenate([[0], np.cumsum(items[starts[1:] - 1])])[:-1] if n else np.zeros(0, np.int64)
                levels.append(Sequence.of(items + base[above]))
                pointers.append(Sequence.of(starts))
            parent = np.cumsum(new) - 1
        return cls(levels, pointers, codes.astype("<u4"))

    def find(self, columns: list[np.ndarray]) -> np.ndarray:
        """Place of each tuple, -1 for those that are not there."""
        found = np.zeros(len(columns[0]), np.int64)
        new = np.zeros(len(found), bool)
        new[:1] = True
        for k, level in enumerate(self.levels):
            # neighbours that begin alike are searched once
            new[1:] |= columns[k][1:] != columns[k][:-1]
            rows = np.flatnonzero(new)
            once = found[rows]
            live = np.flatnonzero(once >= 0)
            x = columns[k][rows[live]].astype(np.int64)
            if k == 0:
                first, last = np.zeros(len(live), np.int64), np.full(len(live), level.n)
            else:
                first, last = (self.pointers[k - 1].get(once[live] + i) for i in (0, 1))
                x = x + np.where(first > 0, level.get(np.maximum(first - 1, 0)), 0) if level.n else x
            place = level.successor(first, last, x)
            there = np.flatnonzero(place < last)
            there = there[level.get(place[there]) == x[there]]
            once[live] = -1
            once[live[there]] = place[there]
            found = once[np.cumsum(new) - 1]
        return found

    def code(self, columns: list[np.ndarray]) -> np.ndarray:
        """Code of each tuple, 0 for those that are not there."""
        codes = np.append(self.codes, np.zeros(1, np.uint32))
        out = [np.zeros(0, np.uint32)]
        for i in range(0, len(columns[0]), SLICE):
            # -1 is the place of the zero behind the codes
            out.append(codes[self.find([c[i : i + SLICE] for c in columns])])
        return np.concatenate(out)

    def tobytes(self) -> bytes:
        parts = [np.array([len(self.levels), len(self.codes)], "<i8").view(np.uint8)]
        for sequence in (*self.levels, *self.pointers):
            parts += sequence.parts()
        return np.concatenate([*parts, self.codes.view(np.uint8)]).tobytes()

    @classmethod
    def open(cls, buffer: bytes | mmap.mmap) -> Trie:
        """A trie on a buffer, such as a memory-mapped file: levels are views, nothing is copied."""
        raw = np.frombuffer(buffer, np.uint8)
        n_levels, n = (int(v) for v in np.frombuffer(raw[:16].tobytes(), "<i8"))
        at, found = 16, []
        for _ in range(2 * n_levels - 1):
            sequence, at = Sequence.read(raw, at)
            found.append(sequence)
        return cls(found[:n_levels], found[n_levels:], np.frombuffer(raw[at : at + 4 * n].tobytes(), "<u4"))
