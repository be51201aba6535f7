"""Adaptive context-mixing range coder for streams of token ids, run over many blocks side by side.

A stream is cut into blocks that start afresh and carry a checksum, so each can be decoded alone. In a block, order 1 (the
last id) and order 2 (the last two) each hold the id they saw last and how often it came again. The surer one names a
candidate; logits of both orders, learned as the block goes on, are added up to the chance that it is right. The range is
divided by that chance, and what is left for a miss by the order-0 distribution of the segment: one coding step an id. All
blocks of a segment take a step at a time in arrays; all arithmetic is on integers, so every machine decodes alike.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

U = np.uint64
LOW32, SHIFT32, ONE32 = U(0xFFFFFFFF), U(32), U(1 << 32)
SLOTS = 1024
FREQ = (1 << 24) - 1
#: chance of a logit in 256ths from -8 to 8, in 4,096ths
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2049) / 256))), 4, 4092).astype(np.int64)


class _Model:
    """Predictions of all blocks: those of order 1, then those of order 2, in flat arrays; ``guess`` before the ids are known, ``learn`` after."""

    def __init__(self, lanes: int, slots: int = SLOTS):
        self.lanes, self.mask, both = lanes, slots - 1, np.arange(2 * lanes)
        self.base, self.seen = both * slots, np.zeros(2 * lanes * slots, np.int32)  # id and count of repeats of each context
        self.row, self.logits = both * 8, np.tile(np.array([-900, -300, -100, 50, 150, 200, 250, 300], np.int32), 2 * lanes)
        self.last, self.slot = np.zeros(lanes, np.int64), np.zeros(2 * lanes, np.int64)  # last id, slots of both contexts
        self.e, self.v, self.p = np.zeros(2 * lanes, np.int32), np.zeros(2 * lanes, np.int32), np.zeros(lanes, np.int64)

    def guess(self) -> tuple[np.ndarray, np.ndarray]:
        """Each block's candidate and its chance in 4,096ths."""
        m = self.lanes
        self.at = self.base + self.slot
        e = self.seen.take(self.at, out=self.e, mode="clip")
        k = e & 7
        self.x = self.row + k
        v = self.logits.take(self.x, out=self.v, mode="clip")
        total = v[:m] + v[m:]
        np.minimum(np.maximum(total, -2048, out=total), 2048, out=total)
        SQUASH.take(total + np.int64(2048), out=self.p, mode="clip")
        guess = np.where(k[m:] >= k[:m], e[m:], e[:m])
        guess >>= 3
        return guess, self.p

    def learn(self, ids: np.ndarray, hit: np.ndarray) -> None:
        m, e, v = self.lanes, self.e, self.v
        step = (((hit.astype(np.int64) << 12) - self.p) >> 6).astype(np.int32)
        v[:m] += step
        v[m:] += step
        self.logits[self.x] = v
        new = ids << 3
        e[:m] -= new  # 0 to 7: the same id, with its count
        e[m:] -= new
        again = e.view(np.uint32) < 8
        np.minimum(e, 6, out=e)
        e += 1
        e *= again
        e[:m] += new
        e[m:] += new
        self.seen[self.at] = e
        wide = ids.astype(np.int64)
        first, second = self.slot[:m], self.slot[m:]
        np.multiply(wide, 40503, out=first)
        np.multiply(self.last, 30011, out=second)
        second += first
        self.slot >>= 5
        self.slot &= self.mask
        self.last = wide


@dataclass
class Segment:
    """A coded stream: order-0 distribution (packed), and of each block its words of 32 bits and the checksum of its ids."""

    n: int
    block: int
    order0: bytes
    words: list[int]
    crcs: list[int]
    payload: bytes


def _order0(ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]:
    top = int(ids.max())
    if top < 1 << 22:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
    else:
        symbols, counts = np.unique(ids, return_counts=True)
    bits = max(16, int(len(symbols)).bit_length() + 2)
    if bits > 22:
        raise ValueError("a segment holds at most a million different ids")
    freq = 1 + counts * ((1 << bits) - len(symbols)) // counts.sum()
    freq[np.argmax(freq)] += (1 << bits) - freq.sum()
    packed = zlib.compress(np.concatenate([[bits], np.diff(symbols, prepend=0), freq]).astype("<u4").tobytes(), 6)
    return packed, symbols, freq, np.cumsum(freq) - freq, bits


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    a = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
    k = (len(a) - 1) // 2
    symbols, freq = np.cumsum(a[1 : 1 + k]), a[1 + k :]
    return symbols, freq, np.cumsum(freq) - freq, int(a[0])


def _left(bits: int) -> int:
    """Bits of the chance that leave the total at 30: 12, or fewer for very many different ids."""
    return min(12, 30 - bits)


def _crcs(ids: np.ndarray, block: int) -> list[int]:
    raw = memoryview(ids.astype("<u4").tobytes())
    return [zlib.crc32(raw[at : at + 4 * block]) for at in range(0, len(raw), 4 * block)]


def _narrow(low: np.ndarray, rng: np.ndarray) -> np.ndarray:
    """Which blocks have used up 32 bits; a range across their border is cut at it, so that the upper word is settled."""
    thin = np.flatnonzero(rng < ONE32)
    if len(thin):
        a, b = low[thin], rng[thin]
        rng[thin] = np.where((a ^ (a + b)) > LOW32, (~a + U(1)) & LOW32, b)
    return thin


def encode(ids: np.ndarray, block: int = 2048) -> Segment:
    """Any ids from 0 to 2**28 - 1; none give a segment without blocks."""
    n = len(ids)
    if not n:
        return Segment(0, block, b"", [], [], b"")
    packed, symbols, freq, start, bits = _order0(ids)
    lanes, left = -(-n // block), _left(bits)
    grid = np.full((lanes, block), ids[-1], np.int32)  # the last block goes on with its last id, which nobody reads
    grid.ravel()[:n] = ids
    grid = np.ascontiguousarray(grid.T)
    shares = start << 24 | freq
    if symbols[-1] < 1 << 22:
        place = np.zeros(int(symbols[-1]) + 1, np.int64)
        place[symbols] = shares
        share = lambda x: place.take(x.astype(np.int64), mode="clip")
    else:
        share = lambda x: shares.take(np.searchsorted(symbols, x))
    model, low, rng = _Model(lanes), np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    out, at = np.zeros((lanes, block * (bits + 14) // 32 + 8), np.uint32), np.zeros(lanes, np.int64)
    for t in range(min(block, n)):
        now = grid[t]
        guess, p = model.guess()
        hit = guess == now
        if left < 12:
            p = np.maximum(1, p >> (12 - left))
        own = share(now)
        miss, mine = (1 << left) - p, p << bits
        begin, width = np.where(hit, 0, mine + miss * (own >> 24)), np.where(hit, mine, miss * (own & FREQ))
        r = rng >> U(left + bits)
        low += begin.view(U) * r
        rng = width.view(U) * r
        thin = _narrow(low, rng)
        if len(thin):
            out[thin, at[thin]] = low[thin] >> SHIFT32
            at[thin] += 1
            low[thin] <<= SHIFT32
            rng[thin] <<= SHIFT32
        model.learn(now, hit)
    for _ in range(2):
        out[np.arange(lanes), at] = low >> SHIFT32
        at += 1
        low = low << SHIFT32
    payload = b"".join(out[i, :k].astype("<u4").tobytes() for i, k in enumerate(at))
    return Segment(n, block, packed, at.tolist(), _crcs(np.asarray(ids), block), payload)


def decode(s: Segment) -> np.ndarray:
    """The ids; ValueError names the first block whose checksum differs."""
    if not s.n:
        return np.zeros(0, np.int32)
    symbols, freq, start, bits = _unpack(s.order0)
    of_slot = np.repeat(np.arange(len(symbols), dtype=np.int64), freq)
    symbols, shares = symbols.astype(np.int32), start << 24 | freq
    lanes, left = -(-s.n // s.block), _left(bits)
    words, sizes = np.frombuffer(s.payload, "<u4"), np.array(s.words, np.int64)
    words = np.concatenate([words, np.zeros(4, "<u4")]).astype(U)
    begin = np.cumsum(sizes) - sizes
    at, model, low, rng = begin + 2, _Model(lanes), np.zeros(lanes, U), np.full(lanes, 2**64 - 1, U)
    code = (words[begin] << SHIFT32) | words[begin + 1]
    grid = np.zeros((s.block, lanes), np.int32)
    top = U((1 << (left + bits)) - 1)
    for t in range(min(s.block, s.n)):
        guess, p = model.guess()
        if left < 12:
            p = np.maximum(1, p >> (12 - left))
        r = rng >> U(left + bits)
        v = np.minimum((code - low) // r, top).view(np.int64)
        mine = p << bits
        hit, miss = v < mine, (1 << left) - p
        k = of_slot.take(np.where(hit, 0, (v - mine) // miss), mode="clip")
        now = np.where(hit, guess, symbols.take(k, mode="clip"))
        own = shares.take(k, mode="clip")
        low += np.where(hit, 0, mine + miss * (own >> 24)).view(U) * r
        rng = np.where(hit, mine, miss * (own & FREQ)).view(U) * r
        thin = _narrow(low, rng)
        if len(thin):
            code[thin] = (code[thin] << SHIFT32) | words.take(at[thin], mode="clip")
            at[thin] += 1
            low[thin] <<= SHIFT32
            rng[thin] <<= SHIFT32
        grid[t] = now
        model.learn(now, hit)
    ids = np.ascontiguousarray(grid.T).ravel()[: s.n]
    for i, (a, b) in enumerate(zip(_crcs(ids, s.block), s.crcs)):
        if a != b:
            raise ValueError(f"block {i} fails its checksum")
    return ids
