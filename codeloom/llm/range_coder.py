"""Adaptive context-mixing range coder for token ids, many blocks at once.

A file is a header, a block table and independent blocks of ``BLOCK`` ids. Every block
starts with an empty model. Order 2 and order 1 each predict one id (the one that followed
the same two, or the same one, before); order 0 is an adaptive distribution over groups of
16 ids. Weights that adapt to how often each order was right mix the three: the coder says
which order gives the id, and order 0 then codes the id. Blocks run in lock-step, one lane
each, so every step is a few array operations over all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 2048
MAGIC, VERSION = b"CLTK", 1
_HEAD = struct.Struct("<4sHHIQ")  # magic, version, bytes of an id, ids of a block, ids of the file
_ENTRY = struct.Struct("<II")  # bytes of a block's payload, its crc32
_BITS = 12
_STEP, _GAIN = 24, 16
_WORD = np.uint64(1 << 32)
_LOW32 = np.uint64(0xFFFFFFFF)
_SHORT = np.uint64(1 << 24)
_S32 = np.uint64(32)


#: Trust (times 65,536) after a miss and a hit at trust 0, 1, 2, 3; at 0 the entry is replaced.
_TRUST = np.array([0, 0, 0, 2, 1, 3, 1, 3]) << 16


class _Model:
    """The models of all lanes. Arrays are flat; lane k owns the k-th stretch of each."""

    def __init__(self, lanes: int) -> None:
        size = 1 << _BITS
        # an entry is the id that followed last, and above it how often it did, up to 3
        self.entry = [np.zeros(lanes * size, np.uint32) for _ in range(2)]
        self.rows = lanes * 32
        self.weight = np.repeat(np.array([8, 8, 16], np.uint64), self.rows)
        # counts of order 0 in three levels of 16; whole numbers below 2^24, exact as floats
        self.top = np.full((lanes, 16), 256, np.float32)
        self.mid = np.full((lanes * 16, 16), 16, np.float32)
        self.leaf = np.full((lanes * 256, 16), 1, np.float32)
        self.total = np.full(lanes, 4096, np.uint64)
        self.lane = np.arange(lanes)
        self.last = [np.zeros(lanes, np.int64) for _ in range(2)]

    def look(self, m: int) -> None:
        """Set what the orders say about the next id of the first m lanes."""
        a, b = self.last[0][:m], self.last[1][:m]
        base = self.lane[:m] << _BITS
        mask = (1 << _BITS) - 1
        a = a * 40503
        self.at = [base + ((a >> 4) & mask), base + (((a + b * 30011 + 77) * 2654435761 >> 13) & mask)]
        found = [self.entry[k].take(self.at[k]).astype(np.int64) for k in range(2)]
        self.said = [x & 0xFFFF for x in found]
        self.sure = [x >> 16 for x in found]
        self.row = (self.lane[:m] << 5) + self.sure[1] * 4 + self.sure[0] + 16 * (self.said[0] == self.said[1])
        odds = [self.weight.take(self.row + k * self.rows) for k in range(3)]
        self.ends = [odds[0], odds[0] + odds[1]]
        self.ends.append(self.ends[1] + odds[2])
        self.odds = odds

    def which(self, ids: np.ndarray) -> np.ndarray:
        """0: order 2 is right; 1: order 1 is; 2: neither."""
        right2 = (self.said[1] == ids) & (self.sure[1] > 0)
        right1 = (self.said[0] == ids) & (self.sure[0] > 0)
        return np.where(right2, 0, np.where(right1, 1, 2))

    def share(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What lies below each order's share of the mixture, and the share."""
        first, second = order == 0, order == 1
        below = np.where(first, np.uint64(0), np.where(second, self.ends[0], self.ends[1]))
        return below, np.where(first, self.odds[0], np.where(second, self.odds[1], self.odds[2]))

    def learn(self, m: int, ids: np.ndarray, order: np.ndarray) -> None:
        at = self.row + order * self.rows
        self.weight[at] = self.weight.take(at) + np.uint64(_GAIN)
        for k in range(2):
            sure = self.sure[k]
            new = _TRUST.take(sure * 2 + (self.said[k] == ids))
            self.entry[k][self.at[k]] = np.where(new == 0, ids + 65536, self.said[k] + new)
        self.last[1][:m] = self.last[0][:m]
        self.last[0][:m] = ids

    def grow(self, lanes: np.ndarray, ids: np.ndarray) -> None:
        for flat, at in ((self.top.ravel(), lanes * 16 + (ids >> 12)), (self.mid.ravel(), lanes * 256 + (ids >> 8)), (self.leaf.ravel(), lanes * 4096 + (ids >> 4))):
            flat[at] = flat.take(at) + np.float32(_STEP)
        self.total[lanes] = self.total.take(lanes) + np.uint64(_STEP)


_BEFORE = np.triu(np.ones((16, 16), np.float32), 1)
_UPTO = np.triu(np.ones((16, 16), np.float32))
_ONES = np.ones(16, np.float32)


def _cell(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each row's column ``at``."""
    return rows.ravel().take(np.arange(0, rows.size, 16) + at)


class _Range:
    """Carry-less range coding: 64-bit low and range, 32 bits shifted out at a time."""

    def __init__(self, lanes: int) -> None:
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, np.uint64(2**64 - 1))

    def narrow(self, lanes, part: np.ndarray, below: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Take the sub-interval; returns which of ``lanes`` shift 32 bits, before they do."""
        low, rng = self.low[lanes] + part * below, part * size
        same = (low ^ (low + rng - np.uint64(1))) < _WORD
        short = ~same & (rng < _SHORT)
        if short.any():
            rng[short] = (np.uint64(0) - low[short]) & _LOW32
        self.low[lanes], self.range[lanes] = low, rng
        return np.flatnonzero(same | short)

    def shift(self, lanes: np.ndarray) -> None:
        self.low[lanes] <<= _S32
        self.range[lanes] <<= _S32


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks given with lengths that do not rise."""
    lanes, longest = len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    ids = np.zeros((longest, lanes), np.uint16)
    for k, b in enumerate(blocks):
        ids[: len(b), k] = b
    model, coder = _Model(lanes), _Range(lanes)
    out = np.zeros((lanes, 2 * longest + 8), np.uint32)
    done = np.zeros(lanes, np.int64)

    def emit(which: np.ndarray) -> None:
        out[which, done[which]] = coder.low[which] >> _S32
        done[which] += 1
        coder.shift(which)

    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # lanes with an id at step t
    for t in range(longest):
        m = int(active[t])
        now = ids[t, :m].astype(np.int64)
        model.look(m)
        order = model.which(now)
        below, size = model.share(order)
        shifting = coder.narrow(slice(0, m), coder.range[:m] // model.ends[2], below, size)
        if len(shifting):
            emit(shifting)
        left = np.flatnonzero(order == 2)
        if len(left):
            x = now[left]
            a, b, c = x >> 12, (x >> 8) & 15, (x >> 4) & 15
            leaf = model.leaf.take(left * 256 + (x >> 8), axis=0)
            below = _cell(model.top.take(left, axis=0) @ _BEFORE, a) + _cell(model.mid.take(left * 16 + a, axis=0) @ _BEFORE, b) + _cell(leaf @ _BEFORE, c)
            size = _cell(leaf, c).astype(np.uint64)
            part = coder.range.take(left) // (model.total.take(left) << np.uint64(4))
            shifting = coder.narrow(left, part, (below.astype(np.uint64) << np.uint64(4)) + size * (x & 15).astype(np.uint64), size)
            if len(shifting):
                emit(left[shifting])
            model.grow(left, x)
        model.learn(m, now, order)
    every = np.arange(lanes)
    emit(every)
    emit(every)
    return [out[k, : done[k]].astype("<u4").tobytes() for k in range(lanes)]


def _decode(payloads: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks whose numbers of ids do not rise."""
    lanes, longest = len(payloads), int(sizes[0])
    words = np.zeros((lanes, max(len(p) for p in payloads) // 4 + 2), np.uint32)
    for k, p in enumerate(payloads):
        words[k, : len(p) // 4] = np.frombuffer(p, "<u4")
    model, coder = _Model(lanes), _Range(lanes)
    code = (words[:, 0].astype(np.uint64) << _S32) | words[:, 1]
    done = np.full(lanes, 2, np.int64)
    ids = np.zeros((longest, lanes), np.uint16)

    def take(which: np.ndarray) -> None:
        code[which] = (code[which] << _S32) | words[which, np.minimum(done[which], words.shape[1] - 1)]
        done[which] += 1
        coder.shift(which)

    active = np.searchsorted(-sizes, -np.arange(longest), "left")
    for t in range(longest):
        m = int(active[t])
        model.look(m)
        part = coder.range[:m] // model.ends[2]
        spot = np.minimum((code[:m] - coder.low[:m]) // part, model.ends[2] - np.uint64(1))
        order = (spot >= model.ends[0]).astype(np.int64) + (spot >= model.ends[1])
        below, size = model.share(order)
        shifting = coder.narrow(slice(0, m), part, below, size)
        if len(shifting):
            take(shifting)
        now = np.where(order == 0, model.said[1], model.said[0]).astype(np.int64)
        left = np.flatnonzero(order == 2)
        if len(left):
            total = model.total.take(left) << np.uint64(4)
            part = coder.range.take(left) // total
            spot = np.minimum((code.take(left) - coder.low.take(left)) // part, total - np.uint64(1))
            rest = (spot >> np.uint64(4)).astype(np.float32)
            a, rest, first, _ = _pick(model.top.take(left, axis=0), rest)
            b, rest, second, _ = _pick(model.mid.take(left * 16 + a, axis=0), rest)
            c, rest, third, size = _pick(model.leaf.take(left * 256 + a * 16 + b, axis=0), rest)
            below = (first + second + third).astype(np.uint64) << np.uint64(4)
            size = size.astype(np.uint64)
            d = ((spot - below) // size).astype(np.int64)
            x = (a << 12) | (b << 8) | (c << 4) | d
            shifting = coder.narrow(left, part, below + size * d.astype(np.uint64), size)
            if len(shifting):
                take(left[shifting])
            model.grow(left, x)
            now[left] = x
        ids[t, :m] = now
        model.learn(m, now, order)
    return [ids[: sizes[k], k] for k in range(lanes)]


def _pick(rows: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The column whose share of its row holds ``spot``, the place within it, what is below, and the share."""
    ends = rows @ _UPTO
    at = ((ends <= spot[:, None]).astype(np.float32) @ _ONES).astype(np.int64)
    size = _cell(rows, at)
    below = _cell(ends, at) - size
    return at, spot - below, below, size


def encode_file(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of ids below 65,536; no ids give a file without blocks."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("an id does not fit two bytes")
    blocks = [ids[k : k + block] for k in range(0, len(ids), block)]
    payloads = [p for k in range(0, len(blocks), LANES) for p in _encode(blocks[k : k + LANES])]
    table = b"".join(_ENTRY.pack(len(p), zlib.crc32(p)) for p in payloads)
    return _HEAD.pack(MAGIC, VERSION, 2, block, len(ids)) + table + b"".join(payloads)


def decode_file(data: bytes) -> np.ndarray:
    """The ids of a file; raises ValueError if the header or a block is damaged."""
    if len(data) < _HEAD.size:
        raise ValueError("not a token file")
    magic, version, width, block, total = _HEAD.unpack_from(data)
    if (magic, version, width) != (MAGIC, VERSION, 2):
        raise ValueError("not a token file of this version")
    count = -(-total // block)
    at = _HEAD.size + count * _ENTRY.size
    payloads = []
    for k in range(count):
        size, crc = _ENTRY.unpack_from(data, _HEAD.size + k * _ENTRY.size)
        payloads.append(data[at : at + size])
        if len(payloads[-1]) != size or zlib.crc32(payloads[-1]) != crc:
            raise ValueError(f"block {k} is damaged")
        at += size
    sizes = np.minimum(block, total - np.arange(count, dtype=np.int64) * block)
    parts = [p for k in range(0, count, LANES) for p in _decode(payloads[k : k + LANES], sizes[k : k + LANES])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16)
