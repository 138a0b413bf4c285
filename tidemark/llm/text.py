"""Words and hashes of many texts at once, as numpy arrays over one Arrow column.

Texts stay UTF-8 bytes. A word is a maximal run of bytes other than space and
0x09 to 0x0D; since those are ASCII, words of bytes are words of characters.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are worked on in slices of about this many bytes; a longer text is one slice.
SLICE_BYTES = 4 << 20
#: Words longer than this are hashed one by one.
LONG_WORD = 128

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


@dataclass
class Words:
    """Words of several texts: byte ranges, and the first word of each text (and the end)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its rows; null is empty."""
    column = one_array(column)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = column.type
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes, in order; all rows are covered."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + size, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def release() -> None:
    """Give memory that earlier work of this process has freed back to the system. Workers are
    used again, stage after stage, and share an executor's memory with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> Words:
    ink = ~_SPACE[data]
    before = np.empty(len(ink) + 1, bool)
    before[0] = before[-1] = False
    before[1:] = ink
    after = before[1:].copy()
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before[cuts] = False
    start = np.flatnonzero(ink & ~before[:-1])
    follows = np.empty(len(ink), bool)
    if len(ink):
        follows[:-1] = ink[1:]
        follows[-1] = False
        follows[cuts - 1] = False
    end = np.flatnonzero(after & ~follows) + 1
    return Words(start, end, np.searchsorted(start, off).astype(np.int64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (in place on a fresh array)."""
    x = x ^ (x >> _U(32))
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of every word."""
    if not len(w):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(data) + 1, 8), (1, 1))
    length = w.end - w.start
    h = length.astype(np.uint64) * _U(0x9E3779B97F4A7C15)
    at, left, which = w.start, length, None
    short = np.minimum(left, LONG_WORD)
    for lane in range(0, LONG_WORD, 8):
        value = np.ascontiguousarray(lanes[at]).view(np.uint64).ravel()
        value &= _KEEP[np.minimum(short - lane, 8)]
        if which is None:
            h = mix(h ^ value)
        else:
            h[which] = mix(h[which] ^ value)
        more = short > lane + 8
        if not more.any():
            break
        which = np.flatnonzero(more) if which is None else which[more]
        at, short = at[more] + 8, short[more]
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(data[w.start[i] : w.end[i]].tobytes(), digest_size=8).digest()
        h[i] ^= _U(int.from_bytes(digest, "little"))
    return h


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive items, by doubling; n - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor, span, power, out, done = 0x5851F42D4C957F2D, h, 1, None, 0
    while True:
        if k & power:
            # Windows are read left to right: what is done so far, then this power of two.
            part = span[done : done + n]
            out = part.copy() if out is None else out * _U(pow(factor, power, 1 << 64)) + part
            done += power
        if power * 2 > k:
            return mix(out)
        span = span[: len(span) - power] * _U(pow(factor, power, 1 << 64)) + span[power:]
        power *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive numbers; n - w + 1 of them."""
    span, have = x, 1
    while have * 2 <= w:
        span = np.minimum(span[: len(span) - have], span[have:])
        have *= 2
    rest = w - have
    return np.minimum(span[: len(span) - rest], span[rest:]) if rest else span


def picks(items: np.ndarray, k: int, w: int, piece: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: for every k + w - 1 consecutive items, where the last of the least of its w
    k-gram hashes is, and that hash.

    A choice depends only on the items of its window, so equal windows choose alike.
    """
    span = k + w - 1
    n = len(items) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, value = np.empty(n, np.int64), np.empty(n, np.uint64)
    low = _U((1 << 16) - 1)
    for a in range(0, n, piece):
        b = min(n, a + piece)
        grams = window_hashes(items[a : b + span - 1], k)
        # Ordered by the upper 48 bits of the hash, then by place from the right.
        key = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
        where = (low - (sliding_min(key, w) & low)).astype(np.int64)
        at[a:b] = where + a
        value[a:b] = grams[where]
    return at, value


def whole_windows(off: np.ndarray, span: int) -> np.ndarray:
    """Of all starts of ``span`` consecutive items, those whose items belong to one text."""
    n = int(off[-1]) - span + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    ends = off[1:]
    late = ranges(np.maximum(off[:-1], ends - span + 1), np.minimum(ends - off[:-1], span - 1))
    ok[late[late < n]] = False
    return ok


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All numbers of the given ranges, one after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = length > 0
    start, length = start[keep], length[keep]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    where = np.cumsum(length)[:-1]
    step[where] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(step)


def covered(n: int, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in at least one of the ranges."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + length, -1)
    return np.cumsum(depth[:-1]) > 0
