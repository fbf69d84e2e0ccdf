"""Hashed word-shingle sets in numpy, straight from Arrow string buffers.

Words are runs without white space, A-Z lower-cased; a word's hash is a
polynomial over its bytes read off one running sum, a shingle's hash mixes the
hashes of its words. Hashes have 64 bits: two different shingles of a pair of
documents agree with a chance below 2^-64 times the product of their counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=U))
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_PLACE = mix(np.arange(1001, 1033, dtype=U)) | U(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(SEGMENT + 4096, _STEP), _powers(SEGMENT + 4096, _BACK)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each document and the end)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=U), np.zeros(len(off), dtype=np.int64)
    space = _SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[off] = True
    begin, last = ~space, ~space
    begin[1:] &= space[:-1] | first[1:n]
    last[:-1] &= space[1:] | first[1:n]
    s, e = np.flatnonzero(begin), np.flatnonzero(last) + 1
    out = np.empty(len(s), dtype=U)
    a = 0
    while a < len(s):                       # whole words, about a segment of bytes at a time
        b = max(a + 1, int(np.searchsorted(e, s[a] + SEGMENT, "right")))
        lo, hi = int(s[a]), int(e[b - 1])
        up, down = (_UP, _DOWN) if hi - lo <= len(_UP) else (_powers(hi - lo, _STEP), _powers(hi - lo, _BACK))
        run = np.zeros(hi - lo + 1, dtype=U)
        np.cumsum(_BYTE[data[lo:hi]] * up[:hi - lo], out=run[1:])
        out[a:b] = mix((run[e[a:b] - lo] - run[s[a:b] - lo]) * down[s[a:b] - lo] + (e[a:b] - s[a:b]).astype(U))
        a = b
    return out, np.searchsorted(s, off)


def sets(col: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text: k words each, the whole
    sequence as one when there are fewer, none without words."""
    h, at = words(*buffers(col))
    m = len(h) - k + 1
    rolled = mix(sum((h[j:j + m] * _PLACE[j] for j in range(k)), U(0))) if m > 0 else h[:0]
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = np.sort(rolled[a:b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(mix((h[a:b] * _PLACE[:b - a]).sum(dtype=U, keepdims=True) + U(b - a)))
        else:
            out.append(h[:0])
    return out
