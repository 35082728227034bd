"""Vectorised scanning of UTF-8 text batches with numpy: words, their hashes, windows."""

from __future__ import annotations

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0xD1342543DE82EF95
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x + _GOLD
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _pow[k] = np.multiply.accumulate(out)
    return _pow[0], _pow[1]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
    """(start, end, text index) of each maximal run of non-separator bytes within one text."""
    m = ~space[data]
    before = np.empty_like(m)
    before[1:] = m[:-1]
    before[:1] = False
    inner = offsets[1:-1]
    before[inner[inner < len(m)]] = False
    starts = np.flatnonzero(m & ~before)
    after = np.empty_like(m)
    after[:-1] = m[1:]
    after[-1:] = False
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(m & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over mixed bytes, finalised with the length."""
    pw, inv = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * pw[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * inv[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * _GOLD))


def windows(h: np.ndarray, doc: np.ndarray, k: int):
    """Hashes of k consecutive words of one text and the index of their first words."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(doc[: len(doc) - k + 1] == doc[k - 1 :])
    out = np.zeros(len(first), np.uint64)
    for i in range(k):
        out = out * np.uint64(_P) + h[first + i]
        out ^= out >> np.uint64(29)
    return mix(out), first


def lowered_words(data: np.ndarray, offsets: np.ndarray):
    low = LOWER[data]
    s, e, d = words(low, offsets)
    return span_hashes(low, s, e), d


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; with 1 to k-1 words one hash of the sequence."""
    h, d = lowered_words(data, offsets)
    n = len(offsets) - 1
    bounds = np.searchsorted(d, np.arange(n + 1))
    win, first = windows(h, d, k)
    cut = np.searchsorted(first, bounds)
    out = []
    for i in range(n):
        a, b = cut[i], cut[i + 1]
        if b > a:
            w = np.sort(win[a:b])
            out.append(w[np.concatenate(([True], w[1:] != w[:-1]))] if b - a > 1 else w)
        elif bounds[i + 1] > bounds[i]:
            own = h[bounds[i] : bounds[i + 1]]
            seq = np.uint64(len(own))
            with np.errstate(over="ignore"):
                for x in own:
                    seq = (seq * np.uint64(_P)) ^ x
            out.append(mix(np.array([seq], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
