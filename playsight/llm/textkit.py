"""Vectorised text helpers shared by the corpus operators.

Everything here runs inside Spark tasks on Arrow batches: words of a whole batch
are found and hashed with a handful of NumPy passes over the UTF-8 buffer, so no
Python loop runs per word.  Hashes are 64-bit: a random-table polynomial hash with
a finaliser.  Two different words (or word sequences) share a hash with
probability of about 2**-64 a pair; operators that rely on it say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a single longer text is still handled whole.
CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INV = np.uint64(pow(int(_STEP), -1, 1 << 64))

#: `[^\x20\x09-\x0D]+`: the bytes that separate words.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Everything but ASCII letters, digits and non-ASCII bytes.
NON_ALNUM = np.ones(256, bool)
NON_ALNUM[0x80:] = False
NON_ALNUM[0x30:0x3A] = False
NON_ALNUM[0x41:0x5B] = False
NON_ALNUM[0x61:0x7B] = False
#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int, base: np.uint64 = _BASE, inverse: np.uint64 = _BASE_INV) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n-1 and their inverses modulo 2**64; those that a usual chunk needs are kept per worker."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, base, np.uint64)
        down = np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size == CHUNK_BYTES + 1:
            _powers[int(base)] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    bufs = column.buffers()
    offsets = np.frombuffer(bufs[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    data, offsets = utf8_parts(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of texts: per word its hash, row, and byte range."""

    __slots__ = ("bounds", "end", "hash", "start")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, hashed: bool = True):
        solid = ~separators[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0], edge[-1] = bool(len(data)) and solid[0], bool(len(data)) and solid[-1]
        if len(data):
            edge[1:-1] = solid[1:] != solid[:-1]
        # a text boundary between two solid bytes ends one word and starts another
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = inner[solid[inner] & solid[inner - 1]] if len(inner) else inner
        marks = np.flatnonzero(edge)
        if len(cut):
            marks = np.sort(np.concatenate([marks, cut, cut]))
        self.start, self.end = marks[0::2], marks[1::2]
        #: word index range of each row: bounds[r] .. bounds[r + 1]
        self.bounds = np.searchsorted(self.start, offsets, "left")
        self.hash = None
        if hashed:
            up, down = _power_tables(len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE_CODE[LOWER[data]] * up[: len(data)], out=total[1:])
            self.hash = mix((total[self.end] - total[self.start]) * down[self.start])


def spans_hash(words: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Hash of the word sequences words[start:start+length]."""
    up, down = _power_tables(len(words) + 1, _STEP, _STEP_INV)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    out = (total[start + length] - total[start]) * down[start]
    return mix(out + np.uint64(0x51ED270B9F652295) * np.asarray(length, np.uint64))


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of each full k-word window; rows given by word bounds."""
    counts = np.maximum(np.diff(bounds) - (k - 1), 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) - before[rows] + bounds[:-1][rows], rows


def sets_of_shingles(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes (all, with n+1 row bounds).

    A text of fewer than k words, but not none, has its whole sequence as its only shingle.
    """
    words = Words(data, offsets)
    n = np.diff(words.bounds)
    start, rows = window_starts(words.bounds, k)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        start = np.concatenate([start, words.bounds[short]])
        rows = np.concatenate([rows, short])
        length = np.full(len(start), k)
        length[-len(short) :] = n[short]
    else:
        length = k
    values = spans_hash(words.hash, start, length)
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    if len(values):
        keep = np.empty(len(values), bool)
        keep[0] = True
        keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        values, rows = values[keep], rows[keep]
    return values, np.searchsorted(rows, np.arange(len(n) + 1))
