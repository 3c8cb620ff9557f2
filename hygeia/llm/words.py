"""Vectorised word, line and window work on the UTF-8 bytes of many texts (numpy, used inside tasks).

A batch is one byte array holding all texts and the offsets of the texts in
it.  Every pass works on pieces of bounded size, so a very long text costs
time, not memory.  Hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, GOLD = 0x9E3779B97F4A7C1F, 0x9E3779B97F4A7C15
PIECE = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply, xor-shift)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(GOLD) + U(seed))


def powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base & (2**64 - 1), dtype=U)
    p[:1] = 1
    return np.multiply.accumulate(p)


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offs) == 0:
        return buf[:0], np.zeros(1, np.int64)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def is_space(buf: np.ndarray) -> np.ndarray:
    return ((buf >= 9) & (buf <= 13)) | (buf == 32)


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of True that doesn't cross a text border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each text the index of its first word (one more at the end)."""
    s, e = spans(~is_space(buf), offs)
    return s, e, np.searchsorted(s, offs)


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each span (spans ascending, not overlapping)."""
    out = np.empty(len(s), U)
    code, i = byte_codes(seed), 0
    inv = pow(BASE, -1, 2**64)
    up = down = np.zeros(0, U)
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + PIECE, "right")))
        lo, hi = int(s[i]), int(e[j - 1])
        if len(up) < hi - lo + 1:
            up, down = powers(hi - lo + 1, BASE), powers(hi - lo + 1, inv)
        c = np.zeros(hi - lo + 1, U)
        np.cumsum(code[buf[lo:hi]] * up[:hi - lo], out=c[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = mix((c[b] - c[a]) * down[a] + (b - a).astype(U) * U(GOLD))
        i = j
    return out


def windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and hash, of every window of ``width`` words inside one text."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    ok = np.zeros(len(h) + 1, np.int32)
    count = np.diff(first)
    has = count >= width
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    out = np.empty(len(at), U)
    for i in range(0, len(at), PIECE):
        p = at[i:i + PIECE]
        acc = h[p].copy()
        for k in range(1, width):
            acc *= U(BASE)
            acc += h[p + k]
        out[i:i + PIECE] = mix(acc)
    return at, out


def owner(first: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The text that holds each word index."""
    return np.searchsorted(first, index, "right") - 1


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``at``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, at, 1)
    np.add.at(d, np.minimum(at + width, n), -1)
    return np.cumsum(d[:-1]) > 0


def per_text(mark: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many marks are set in each range of ``offs``."""
    c = np.zeros(len(mark) + 1, np.int64)
    np.cumsum(mark, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]


def order_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable sorting order of hashes, and the sorted hashes.

    Sorts the high bits with the position in the low bits (one plain sort); hashes that
    only differ in the low bits are then put right."""
    bits = U(max(1, (len(h) - 1).bit_length()))
    key = ((h >> bits) << bits) | np.arange(len(h), dtype=U)
    key.sort()
    o = (key & ((U(1) << bits) - U(1))).astype(np.int64)
    s = h[o]
    if (s[1:] < s[:-1]).any():
        o = o[np.argsort(s, kind="stable")]
        s = h[o]
    return o, s


def give_back() -> None:
    """Freed memory goes back to the system: worker processes outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass
