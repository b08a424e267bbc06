"""Vectorised text kernels shared by the corpus operators.

They run inside Spark tasks on Arrow columns: bytes in, numpy arrays out.  Words are maximal runs of bytes
other than space and ``\\t..\\r`` after lower-casing ``A-Z``; both rules are ASCII, so UTF-8 needs no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
_BASE = 0x9E3779B97F4A7C17  # odd, and 3 mod 4
_BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 64, 256, dtype=_U)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _rng.integers(0, 1 << 64, 64, dtype=_U) | _U(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, _U)
    out[1:] = _U(base)
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, _BLOCK + 1)
_INV = _powers(pow(_BASE, -1, 1 << 64), _BLOCK + 1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and ``len + 1`` offsets; a null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (``len + 1`` values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, the same for ``A-Z`` and ``a-z``: a rolling polynomial, finalised."""
    out = np.empty(len(s), _U)
    i = 0
    while i < len(s):
        lo = int(s[i])
        j = int(np.searchsorted(e, lo + _BLOCK, "right"))
        if j <= i:  # one word longer than a block
            w = data[lo : int(e[i])].copy()
            w[(w >= 65) & (w <= 90)] += 32
            out[i] = xxhash.xxh64_intdigest(w.tobytes())
            i += 1
            continue
        hi = int(e[j - 1])
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(_BYTE[data[lo:hi]] * _POW[: hi - lo], out=total[1:])
        a, b = s[i:j] - lo, e[i:j] - lo
        out[i:j] = (total[b] - total[a]) * _INV[a]
        i = j
    return mix64(out)


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and, for each text, where its runs begin (``len + 1`` values).

    A text of 1 to ``k - 1`` words has its whole sequence as its one run; one without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(count, out=at[1:])
    out = np.zeros(int(at[-1]), _U)
    full = n >= k
    if full.any():
        c = count[full]
        head = np.cumsum(c) - c
        idx = np.arange(int(c.sum())) + np.repeat(first[:-1][full] - head, c)
        acc = h[idx] * _PLACE[0]
        for j in range(1, k):
            acc += h[idx + j] * _PLACE[j]
        out[np.repeat(full, count)] = mix64(acc)
    for d in np.flatnonzero((n > 0) & (n < k)):
        w = h[first[d] : first[d + 1]]
        out[at[d]] = mix64(np.append(w * _PLACE[: len(w)], _PLACE[32 + min(len(w), 31)]).sum(keepdims=True))[0]
    return out, at


def shingle_sets(col: pa.Array, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of the column its number and its sorted distinct shingle hashes."""
    data, offsets = text_buffer(col)
    for i, j in row_blocks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, first = words(part, off)
        sh, at = shingle_hashes(word_hashes(part, s, e), first, k)
        for r in range(j - i):
            x = np.sort(sh[at[r] : at[r + 1]])
            if len(x) > 1:
                keep = np.empty(len(x), bool)
                keep[0] = True
                np.not_equal(x[1:], x[:-1], out=keep[1:])
                x = x[keep]
            yield i + r, x
