"""Distinct stretches of bytes, numbered as they are met and found again by hash, with every byte compared.

A hash only proposes a number. All occurrences are compared with the numbered stretch byte by byte, and a stretch whose
hash belongs to another one is kept in a dictionary of its own bytes, so that numbers are right whatever the hashes do.
"""

from __future__ import annotations

import numpy as np

from . import bytestext as bt


PART = 1 << 18


class Growing:
    """An array that takes more rows at its end."""

    def __init__(self, kind) -> None:
        self.held, self.size = np.zeros(1024, dtype=kind), 0

    def add(self, rows: np.ndarray) -> None:
        need = self.size + len(rows)
        if need > len(self.held):
            self.held = np.concatenate((self.held[: self.size], np.zeros(max(need, len(self.held)), dtype=self.held.dtype)))
        self.held[self.size : need] = rows
        self.size = need

    def __call__(self) -> np.ndarray:
        return self.held[: self.size]


class Stretches:
    """most: stretches, and most_bytes: bytes of them, beyond which it is full and to be started afresh before the next chunk."""

    def __init__(self, most: int, most_bytes: int = 64 << 20) -> None:
        self.most, self.most_bytes = most, most_bytes
        self.slots = 1 << (4 * most - 1).bit_length()
        self.forget()

    def forget(self) -> None:
        self.table = np.full(self.slots, -1, dtype=np.int32)  # open addressing: the number at a hash's place or after it
        self.hashes, self.flat, self.starts = Growing(np.uint64), Growing(np.uint8), Growing(np.int64)
        self.starts.add(np.zeros(1, dtype=np.int64))
        self.clashing: dict[bytes, int] = {}

    def full(self) -> bool:
        return self.hashes.size > self.most or self.flat.size > self.most_bytes

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The number proposed for each hash; -1 for none."""
        mask, known = np.uint64(self.slots - 1), self.hashes()
        place = (hashes & mask).astype(np.int64)
        out = self.table[place].astype(np.int64)
        if not len(known):
            return out
        left = np.flatnonzero(out >= 0)
        left = left[known[out[left]] != hashes[left]]
        while len(left):
            place[left] = (place[left] + 1) & (self.slots - 1)
            out[left] = self.table[place[left]]
            left = left[out[left] >= 0]
            left = left[known[out[left]] != hashes[left]]
        return out

    def _insert(self, hashes: np.ndarray, first: int) -> None:
        """Distinct hashes that aren't in the table get the numbers from first on."""
        place = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.table[place[left]] < 0]
            self.table[place[free]] = free + first
            left = left[self.table[place[left]] != left + first]
            place[left] = (place[left] + 1) & (self.slots - 1)

    def _store(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        sizes = ends - starts
        base = self.flat.size
        self.flat.add(flat[bt.ragged(starts, sizes)])
        self.starts.add(base + np.cumsum(sizes))
        self.hashes.add(hashes)

    def _different(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Where a stretch isn't the one of its number, byte by byte; PART bytes at a time, to keep what is compared small."""
        sizes, at, held = ends - starts, self.starts(), self.flat()
        wrong = [np.flatnonzero(at[numbers + 1] - at[numbers] != sizes)]
        low = 0
        while low < len(starts):
            high = max(low + 1, int(np.searchsorted(ends, starts[low] + PART, side="right")))
            own = held[np.minimum(bt.ragged(at[numbers[low:high]], sizes[low:high]), len(held) - 1)]
            bad = np.flatnonzero(own != flat[starts[low] : ends[high - 1]])
            if len(bad):
                wrong.append(np.searchsorted(starts, starts[low] + bad, side="right") - 1)
            low = high
        return np.unique(np.concatenate(wrong))

    def number(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each stretch, and where the new ones first stand, in the order of their numbers. The stretches cover flat."""
        hashes = bt.hash_spans(flat, starts, ends)
        before = self.hashes.size
        out = self._find(hashes)
        missed = np.flatnonzero(out < 0)
        fresh = missed
        if len(missed):
            keys, first = np.unique(hashes[missed], return_index=True)
            fresh = missed[first]
            self._insert(keys, before)
            self._store(flat, starts[fresh], ends[fresh], keys)
            out[missed] = self._find(hashes[missed])
        wrong = self._different(flat, starts, ends, out)
        more = []
        for i in wrong.tolist():
            own = flat[starts[i] : ends[i]].tobytes()
            if own not in self.clashing:
                self.clashing[own] = self.hashes.size
                self._store(flat, starts[i : i + 1], ends[i : i + 1], hashes[i : i + 1])
                more.append(i)
            out[i] = self.clashing[own]
        return out, np.concatenate((fresh, np.array(more, dtype=np.int64)))
