"""An open-addressed NumPy table of the n-grams of a batch.

Keys are 64-bit xxhash values of an n-gram's bytes, computed for all n-grams at once.
Slots are found by linear probing, all pending n-grams a step at a time, and a slot counts
as found only if the bytes agree with those it was made for.
"""

from __future__ import annotations

import zlib

import numpy as np

# Fixed values of the public xxHash-64 algorithm.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _step(lane: np.ndarray, held: np.ndarray | np.uint64 = np.uint64(0)) -> np.ndarray:
    return _turn(held + lane * P2, 31) * P1


class Ranges:
    """Byte ranges (``start``, ``size``) of one buffer, read eight bytes at a time."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.text = np.concatenate([text, np.zeros(8, np.uint8)])
        self.lanes = np.ndarray((len(text) + 1,), "<u8", self.text, strides=(1,))
        self.start, self.size = start.astype(np.int64), size.astype(np.int64)

    def __len__(self) -> int:
        return len(self.start)

    def lane(self, which: np.ndarray, at: int | np.ndarray) -> np.ndarray:
        return self.lanes[self.start[which] + at]

    def bytes(self, k: int) -> bytes:
        return self.text[self.start[k] : self.start[k] + self.size[k]].tobytes()

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether ranges ``a`` and ``b`` hold the same bytes, element by element."""
        same = self.size[a] == self.size[b]
        left, at = np.flatnonzero(same & (self.size[a] > 0)), 0
        while len(left):
            rest = np.minimum(self.size[a[left]] - at, 8).astype(np.uint64)
            spare = np.uint64(64) - rest * np.uint64(8)
            alike = (self.lane(a[left], at) << spare) == (self.lane(b[left], at) << spare)
            same[left[~alike]] = False
            at += 8
            left = left[alike & (self.size[a[left]] > at)]
        return same

    def xxhash64(self) -> np.ndarray:
        """The xxHash-64 (seed 0) of every range."""
        out = np.full(len(self), P5)
        large = np.flatnonzero(self.size >= 32)
        if len(large):
            out[large] = self._stripes(large)
        out += self.size.astype(np.uint64)
        at = self.size & ~np.int64(31)  # bytes done
        which = np.flatnonzero(self.size - at >= 8)
        while len(which):
            out[which] = _turn(out[which] ^ _step(self.lane(which, at[which])), 27) * P1 + P4
            at[which] += 8
            which = which[self.size[which] - at[which] >= 8]
        which = np.flatnonzero(self.size - at >= 4)
        low = self.lane(which, at[which]) & np.uint64(0xFFFFFFFF)
        out[which] = _turn(out[which] ^ (low * P1), 23) * P2 + P3
        at[which] += 4
        which = np.flatnonzero(self.size > at)
        while len(which):
            out[which] = _turn(out[which] ^ (self.text[self.start[which] + at[which]].astype(np.uint64) * P5), 11) * P1
            at[which] += 1
            which = which[self.size[which] > at[which]]
        out = (out ^ (out >> np.uint64(33))) * P2
        out = (out ^ (out >> np.uint64(29))) * P3
        return out ^ (out >> np.uint64(32))

    def _stripes(self, large: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            held = np.repeat(np.array([[P1 + P2], [P2], [np.uint64(0)], [np.uint64(0) - P1]], np.uint64), len(large), axis=1)
        left, at = np.arange(len(large)), 0
        while len(left):
            for k in range(4):
                held[k, left] = _step(self.lane(large[left], at + 8 * k), held[k, left])
            at += 32
            left = left[self.size[large[left]] - at >= 32]
        out = _turn(held[0], 1) + _turn(held[1], 7) + _turn(held[2], 12) + _turn(held[3], 18)
        for k in range(4):
            out = (out ^ _step(held[k])) * P1 + P4
        return out


class GramTable:
    """``slot`` of every n-gram of a batch; per slot its ``bucket`` and ``count``.

    The table has at least twice as many slots as the batch has n-grams.
    """

    def __init__(self, grams: Ranges, buckets: int) -> None:
        size = 1 << max(4, int(2 * len(grams) - 1).bit_length())
        self.slot = np.zeros(len(grams), np.int64)
        holder = np.full(size, -1, np.int64)  # the n-gram a slot was made for
        keys = grams.xxhash64()
        at = (keys & np.uint64(size - 1)).astype(np.int64)
        todo = np.arange(len(grams))
        while len(todo):
            place = at[todo]
            free = np.flatnonzero(holder[place] < 0)
            holder[place[free]] = todo[free]
            met = holder[place]
            found = keys[met] == keys[todo]
            found[found] = grams.equal(met[found], todo[found])
            self.slot[todo[found]] = place[found]
            todo = todo[~found]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.count = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(holder >= 0)
        self.bucket[used] = [zlib.crc32(grams.bytes(k)) % buckets for k in holder[used].tolist()]
