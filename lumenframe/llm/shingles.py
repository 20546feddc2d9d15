"""Word shingles of whole texts as 64-bit hashes, for a batch of texts at once with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered. A
document's set holds its distinct runs of ``k`` words; with fewer words, the
whole sequence is one; without words the set is empty.
"""

from __future__ import annotations

import numpy as np

from .common import ship

ship(__name__)

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _powers, _inverse
    if len(_powers) < n:
        n = max(n, 1 << 16)
        inv = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("_powers", _BASE), ("_inverse", inv)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _powers, _inverse


def shingle_hashes(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document number, hash) of every shingle occurrence, in text order."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    start = np.flatnonzero(~space & before)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    end = np.flatnonzero(space & ~before)
    # the text with one space between words: positions shift by the spaces dropped
    keep = ~(space & before)
    low = _LOWER[raw[keep]]
    low[space[keep]] = 32
    shift = np.cumsum(~keep)
    doc = np.searchsorted(ends, start, side="right")
    s, e = start - shift[start], end - shift[end]
    up, down = powers(len(low) + 1)
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[low] * up[: len(low)], out=total[1:])
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    at = np.arange(len(start))
    last = at + (k - 1)
    whole = np.minimum(k, n)[doc]
    last = at + whole - 1
    good = last < (first + n)[doc]
    good &= (n[doc] >= k) | (at == first[doc])
    a, b = s[good], e[last[good]]
    h = (total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
    return doc[good], mix(h)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    doc, h = shingle_hashes(texts, k)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    cuts = np.searchsorted(doc, np.arange(1, len(texts)))
    return np.split(h, cuts)


def slices(texts, most: int = 1 << 20):
    """Slices of a list of texts (bytes) of about ``most`` bytes each, as (from, to)."""
    a = held = 0
    for i, t in enumerate(texts):
        held += len(t) + 1
        if held >= most:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
