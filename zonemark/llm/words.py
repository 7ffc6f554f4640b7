"""Word fingerprints of whole texts, computed over Arrow buffers.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D.  Its fingerprint is a polynomial over a
fixed random table of the bytes, modulo 2**64, from running sums, so a batch costs a few array passes
whatever the words are.  Fingerprints have 64 bits; they stand for the words in everything that follows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x5851F42D4C957F2D | 3)
_ROW = _rng.integers(1, 1 << 63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE2 = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POWERS[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


@dataclass
class Words:
    """Of a slice of texts: fingerprints of all words in order, their first and end byte in ``raw``,
    and per text the bounds of its words."""

    print: np.ndarray
    first: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray


def fingerprints(texts: pa.Array, fold_case: bool) -> Words:
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data else np.empty(0, np.uint8)
    off = off - off[0]
    word = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | edge[1:-1]
    ends[:-1] &= ~word[1:] | edge[1:-1]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[raw] if fold_case else raw] * power[: len(raw)], out=sums[1:])
    h = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
    return Words(h, first, end, np.searchsorted(first, off), raw)


def second(w: Words) -> np.ndarray:
    """Fingerprints of the words that have nothing in common with the first ones: another table of the
    bytes, and a word's bytes taken from its end on."""
    power, inverse = _powers(len(w.raw) + 1)
    sums = np.zeros(len(w.raw) + 1, np.uint64)
    np.cumsum(_BYTE2[w.raw] * inverse[: len(w.raw)], out=sums[1:])
    return mix((sums[w.end] - sums[w.first]) * power[w.end] ^ (w.end - w.first).astype(np.uint64))


def runs(h: np.ndarray, width: int, kind: int = 0) -> np.ndarray:
    """Fingerprints of the runs of ``width`` consecutive words, by where they begin."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n] * _ROW[kind, 0]
    for k in range(1, width):
        out += h[k : k + n] * _ROW[kind, k]
    return mix(out)


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, pa.Array]]:
    """(place of the first, texts) of about ``size`` bytes; a longer text is a slice of its own."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(n)
    lo = 0
    while lo < len(texts):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + size, "right")))
        yield lo, texts.slice(lo, hi - lo)
        lo = hi
