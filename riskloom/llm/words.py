"""Words and word hashes of many texts at once (numpy, inside Spark tasks).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, the byte view
of ``[^\\x20\\x09-\\x0D]+`` on UTF-8 text.  A word's hash is a 64-bit polynomial
of its bytes, read from prefix sums, so no Python loop runs over words.
Work is cut into chunks of bytes, so memory stays at a few times one chunk
plus eight bytes per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 1 << 20
_HASHED = 1 << 18  # bytes hashed at a time: powers and sums stay in cache

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_GOLDEN = 0x9E3779B97F4A7C15
_BASE = _GOLDEN
_BASE_INV = pow(_BASE, -1, 1 << 64)
_pow: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow
    if len(_pow[0]) < n:
        out = []
        for base in (_BASE, _BASE_INV):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            out.append(np.cumprod(a))
        _pow = (out[0], out[1])
    return _pow


def salt(i: int) -> np.uint64:
    """The i-th of a fixed series of 64-bit numbers."""
    return np.uint64(i * _GOLDEN & (1 << 64) - 1)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), on uint64 arrays."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """Words of a list of texts.

    ``start`` and ``end`` are byte positions in ``buf`` (the texts, one white
    space byte after each), ``hash`` the 64-bit word hashes, and
    ``first[i]:first[i + 1]`` the words of text i.
    """

    def __init__(self, texts: list[bytes | None], lower: bool = False, hashes: bool = True):
        texts = [t or b"" for t in texts]
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, np.uint8)
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        word = ~_SPACE[buf]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.text_at = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.start, self.text_at)
        self.hash = self._hashes() if hashes else None

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = int(np.searchsorted(self.start, self.start[i] + _HASHED))
            at = int(self.start[i])
            part = self.buf[at:int(self.end[j - 1])]
            up, down = _powers(len(part) + 1)
            run = np.empty(len(part) + 1, np.uint64)
            run[0] = 0
            np.cumsum(_BYTE[part] * up[: len(part)], out=run[1:])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(_BASE)
            i = j
        return mix64(out)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """Index of the text of each word position in ``at``."""
        return np.searchsorted(self.first, at, side="right") - 1


def slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a batch of texts into runs of about ``limit`` bytes, one text at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def windows_hash(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive word hashes (len - n + 1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for i in range(n):
        acc *= np.uint64(_BASE)
        acc += h[i:i + m]
    return mix64(acc)


def sliding_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest value (leftmost of ties) of each window of ``w``."""
    m = len(v) - w + 1
    if m <= 0:
        return np.empty(0, np.int64)
    best, at, span = v, np.arange(len(v)), 1
    while span * 2 <= w:
        a, b = best[:-span], best[span:]
        right = b < a
        at = np.where(right, at[span:], at[:-span])
        best = np.where(right, b, a)
        span *= 2
    if span < w:
        d = w - span
        right = best[d:] < best[:-d]
        at = np.where(right, at[d:], at[:-d])
    return at[:m]
