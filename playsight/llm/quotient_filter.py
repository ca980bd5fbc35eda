"""Counting quotient filters over packed word-id n-grams: lossless, sorted, compact counters.

An n-gram of up to three word ids (0: none) is packed into 3 * bits bits, split into two halves and permuted
by a Feistel network, so that it can be had back from the permuted key.  The key's leading bits are its
quotient, the rest its full remainder.  A filter keeps, in the order of keys: a bit for each quotient
of its range that occurs (occupied), a bit an entry that ends the run of a quotient (run end), the remainders
in whole bytes, and a counter of one byte an entry, with larger counts in a list of their own.  As
filters are sorted, they are merged without looking anything up.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

from playsight.llm.textkit import mix

_ROUNDS = [np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)]
_HEAD = struct.Struct("<IIBBQQ")
#: Widest word id: both halves of a packed n-gram then fit 63 bits.
WIDEST = 42


def half_bits(bits: int) -> int:
    """Bits of a half of a packed n-gram of three ids of `bits` bits."""
    return (3 * bits + 1) // 2


def pack(w1: np.ndarray, w2: np.ndarray, w3: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the packed ids."""
    if bits > WIDEST:
        raise ValueError(f"word ids have {WIDEST} bits at most")
    w1, w2, w3 = (np.asarray(x).astype(np.uint64) for x in (w1, w2, w3))
    low = half_bits(bits) - bits
    return (w1 << np.uint64(bits - low)) | (w2 >> np.uint64(low)), ((w2 & np.uint64((1 << low) - 1)) << np.uint64(bits)) | w3


def unpack(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of pack()."""
    low = half_bits(bits) - bits
    w2 = ((hi & np.uint64((1 << (bits - low)) - 1)) << np.uint64(low)) | (lo >> np.uint64(bits))
    return (hi >> np.uint64(bits - low)).astype(np.int64), w2.astype(np.int64), (lo & np.uint64((1 << bits) - 1)).astype(np.int64)


def permute(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """A permutation of keys of two halves of so many bits."""
    mask = np.uint64((1 << half) - 1)
    for k in _ROUNDS:
        hi, lo = lo, hi ^ (mix(lo + k) & mask)
    return hi, lo


def restore(hi: np.ndarray, lo: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of permute()."""
    mask = np.uint64((1 << half) - 1)
    for k in reversed(_ROUNDS):
        hi, lo = lo ^ (mix(hi + k) & mask), hi
    return hi, lo


def summed(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    if not len(hi):
        return hi, lo, counts
    order = np.argsort((hi << np.uint64(half)) | lo, kind="stable") if 2 * half <= 64 else np.lexsort((lo, hi))
    hi, lo, counts = hi[order], lo[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
    return hi[first], lo[first], np.add.reduceat(counts, first)


def shard_bounds(hi: np.ndarray, half: int, shards: int) -> np.ndarray:
    """Where each shard (an equal range of quotients) begins among sorted keys, and the end."""
    top = min(half, 31)
    shard = ((hi >> np.uint64(half - top)) * np.uint64(shards)) >> np.uint64(top)
    return np.searchsorted(shard, np.arange(shards + 1))


def store(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray, half: int, shards: int = 1) -> bytes:
    """A filter of sorted different keys, which lie in one of `shards` ranges; about one quotient a key."""
    n = len(hi)
    want = max(1, n * shards).bit_length() - 1
    # of the widths about this one, that which leaves whole bytes of remainder
    wide = min(range(max(0, 2 * half - 120), half + 1), key=lambda q: (((2 * half - q) % 8 != 0) * 64 + abs(q - want), q))
    size = -(-(2 * half - wide) // 8)
    rest = half - wide
    quotient = hi >> np.uint64(rest)
    base = int(quotient[0]) if n else 0
    occupied = np.zeros(int(quotient[-1]) - base + 1 if n else 0, bool)
    occupied[(quotient - np.uint64(base)).astype(np.int64)] = True
    end = np.ones(n, bool)
    end[:-1] = quotient[1:] != quotient[:-1]
    low = lo | ((hi & np.uint64((1 << rest) - 1)) << np.uint64(half)) if half < 64 else lo  # what of the remainder fits 64 bits
    high = (hi & np.uint64((1 << rest) - 1)) >> np.uint64(64 - half)
    planes = np.concatenate([x.astype("<u8").view(np.uint8).reshape(-1, 8).T for x in (low, high)])[:size]
    large = np.flatnonzero(counts >= 255)
    small = zstandard.ZstdCompressor(level=1).compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes())
    return b"".join([_HEAD.pack(n, len(occupied), wide, half, base, len(small)), np.packbits(occupied).tobytes(), np.packbits(end).tobytes(), np.ascontiguousarray(planes).tobytes(), small])


def load(stored: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted keys and counts of a filter."""
    n, span, wide, half, base, packed = _HEAD.unpack_from(stored)
    raw, at = np.frombuffer(stored, np.uint8), _HEAD.size
    occupied = np.flatnonzero(np.unpackbits(raw[at : at + -(-span // 8)], count=span))
    at += -(-span // 8)
    end = np.unpackbits(raw[at : at + -(-n // 8)], count=n)
    at += -(-n // 8)
    size, rest = -(-(2 * half - wide) // 8), half - wide
    planes = np.zeros((16, n), np.uint8)
    planes[:size] = raw[at : at + size * n].reshape(size, n)
    low, high = (np.ascontiguousarray(x.T).view("<u8").ravel().astype(np.uint64) for x in (planes[:8], planes[8:]))
    run = np.cumsum(end) - end
    quotient = occupied[run].astype(np.uint64) + np.uint64(base) if n else np.zeros(0, np.uint64)
    upper = (low >> np.uint64(half)) | (high << np.uint64(64 - half))
    hi, lo = (quotient << np.uint64(rest)) | (upper & np.uint64((1 << rest) - 1)), low & np.uint64((1 << half) - 1)
    small = np.frombuffer(zstandard.ZstdDecompressor().decompress(stored[len(stored) - packed :]), np.uint8)
    counts = small[:n].astype(np.int64)
    counts[counts == 255] = small[n:].view("<u8").astype(np.int64)
    return hi, lo, counts


class Merge:
    """Adds filters up; what waits is merged when it is as much as what is held, so a key is moved a few times only."""

    def __init__(self, half: int, patience: int = 1 << 18):
        self.half, self.patience = half, patience
        self.held = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, stored: bytes) -> None:
        self.waiting.append(load(stored))
        self.n += len(self.waiting[-1][0])
        if self.n > max(self.patience, len(self.held[0])):
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sorted keys and counts of all filters so far."""
        if self.waiting:
            self.held = summed(*(np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True)), self.half)
            self.waiting, self.n = [], 0
        return self.held
