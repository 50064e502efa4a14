"""Numpy kernels over the byte buffers of Arrow string columns.

Everything here works on many documents at once: a chunk is the concatenation
of whole documents, with ``bounds`` holding the offset of each one.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: An odd multiplier, its inverse modulo 2**64, and the mixing constants of splitmix64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Random 64-bit values of the 256 bytes; the seed is part of the format of every hash.
BYTE_HASH = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: White space that separates words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower case for A to Z only; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 18  # arrays of 8 bytes for each byte of it stay in a core's cache
TRIM_BYTES = 16 << 20

_powers = (np.ones(1, U64), np.ones(1, U64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for b in (BASE, BASE_INV):
            p = np.full(size, b, U64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x *= U64(MIX_1)
    x ^= x >> U64(27)
    x *= U64(MIX_2)
    x ^= x >> U64(31)
    return x


class Prefix:
    """Prefix sums that give the hash of any range of a sequence of symbols."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        p, self.inv = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * p[:n], out=self.sums[1:])

    def window(self, k: int) -> np.ndarray:
        """The hash of each run of k symbols."""
        n = len(self.sums) - 1
        if n < k:
            return np.empty(0, U64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inv[: n - k + 1])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        raw = (self.sums[hi] - self.sums[lo]) * self.inv[lo]
        return mix(raw + (hi - lo).astype(U64) * U64(MIX_2))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[bounds[0] : bounds[-1]] if len(raw) else raw, bounds - bounds[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_since_trim = 0


def trimmed(n: int) -> None:
    """Count n bytes of text as worked on; now and then give freed memory back, which the allocators would keep."""
    global _since_trim
    _since_trim += n
    if _since_trim >= TRIM_BYTES:
        _since_trim = 0
        pa.default_memory_pool().release_unused()
        if _trim is not None:
            _trim(0)


def chunks(bounds: np.ndarray, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of about limit bytes, at least one document each."""
    i, n = 0, len(bounds) - 1
    limit = limit or CHUNK_BYTES
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)
    trimmed(int(bounds[-1]))


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk, and for each document the index of its first word."""
    n = len(data)
    inside = np.empty(n + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(IS_SPACE[data], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):  # a document's end parts two words that touch
        cut = np.unique(inner[(inside[inner] == 1) & (inside[inner + 1] == 1)])
        if len(cut):
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, bounds)


def loads(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, zeros beyond the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,)).astype(U64)


#: Bytes of a word beyond which it is hashed by itself.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: its blocks of 8 bytes go through mix() one after another, so that no pattern of letters cancels out."""
    size = ends - starts
    out = mix(size.astype(U64) * U64(MIX_1) + U64(BASE))
    if not len(size):
        return out
    block = loads(data)
    live = np.arange(len(size))
    for step in range(0, LONG_WORD, 8):
        rest = size[live] - step
        live, rest = live[rest > 0], rest[rest > 0]
        if not len(live):
            break
        own = block[starts[live] + step]
        short = rest < 8
        own[short] &= (U64(1) << (rest[short] * 8).astype(U64)) - U64(1)
        out[live] = mix(out[live] ^ own)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


#: Bytes that each symbol of byte_symbols() reads beyond its own.
REACH = 7


def byte_symbols(data: np.ndarray) -> np.ndarray:
    """A symbol for each place, mixed from the 8 bytes there, so that no pattern of bytes cancels out in sums."""
    x = loads(data)[: len(data)]
    x *= U64(MIX_1)
    x ^= x >> U64(29)
    x *= U64(MIX_2)
    x ^= x >> U64(32)
    return x


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


def in_spans(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """True where a position of [0, n) lies in one of the spans [lo, hi)."""
    d = np.bincount(lo, minlength=n + 1)[: n + 1] - np.bincount(hi, minlength=n + 1)[: n + 1]
    return np.cumsum(d[:n]) > 0


#: Low bits of a packed minimum hold the position, so a piece has fewer symbols than this.
POSITION_BITS = 24
PIECE = 1 << 22


def minimizers(prefix: Prefix, bounds: np.ndarray, k: int, width: int, reach: int = 0) -> np.ndarray:
    """Start of the k-gram of least hash, the leftmost if tied, of every window of k + width - 1 symbols.

    Windows lie inside one document. Equal windows choose the same place, wherever they stand.
    """
    span, n = k + width - 1, int(bounds[-1])
    if n < span:
        return np.empty(0, np.int64)
    low = U64((1 << POSITION_BITS) - 1)
    packed = (prefix.window(k - reach)[: n - k + 1] & ~low) | np.arange(n - k + 1, dtype=U64)
    least = sliding_min(packed, width)
    ends = bounds[1:]
    lo = np.maximum(bounds[:-1], ends - span + 1)
    bad = in_spans(n, lo[lo < ends], ends[lo < ends])[: len(least)]
    at = (least[~bad] & low).astype(np.int64)
    return at[np.flatnonzero(np.diff(at, prepend=-1))] if len(at) else at


def anchors(symbols: np.ndarray, bounds: np.ndarray, k: int, width: int, reach: int = 0) -> tuple[np.ndarray, ...]:
    """Of every anchor: its document, its place in it, the hash of its k-gram and that of its context.

    The context is what all windows over the anchor cover, cut at the document's ends. A symbol tells of so many
    further ones as reach says, so the last of a k-gram need not be looked at.
    """
    span = k + width - 1
    if int(bounds[-1]) <= PIECE:
        return _anchors(symbols, bounds, k, width, reach)
    made = []
    for d in range(len(bounds) - 1):
        lo, hi = int(bounds[d]), int(bounds[d + 1])
        for at in range(lo, max(lo + 1, hi), PIECE // 2):
            a, b = max(lo, at - span), min(hi, at + PIECE // 2 + 2 * span)
            _, place, gram, context = _anchors(symbols[a:b], np.array([0, b - a]), k, width, reach)
            inner = ((place >= span) | (a == lo)) & ((place <= b - a - span) | (b == hi))
            made.append(np.stack([np.full(inner.sum(), d, U64), (place[inner] + a - lo).astype(U64), gram[inner], context[inner]]))
    _, first = np.unique((all_ := np.concatenate(made, axis=1))[0] * U64(1 << 40) + all_[1], return_index=True)
    doc, place, gram, context = all_[:, first]
    return doc.astype(np.int64), place.astype(np.int64), gram, context


def _anchors(symbols: np.ndarray, bounds: np.ndarray, k: int, width: int, reach: int) -> tuple[np.ndarray, ...]:
    prefix = Prefix(symbols)
    at = minimizers(prefix, bounds, k, width, reach)
    doc = np.searchsorted(bounds, at, "right") - 1
    first, last = bounds[doc], bounds[doc + 1]
    lo, hi = np.maximum(first, at - width + 1), np.minimum(last, at + k + width - 1)
    gram = prefix.ranges(at, at + k - reach)
    context = mix(prefix.ranges(lo, hi - reach) + (at - lo).astype(U64) * U64(MIX_1))
    return doc, at - first, gram, context
