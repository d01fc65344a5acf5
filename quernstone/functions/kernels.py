"""Vectorised text kernels over the code points of many texts at once.

A slice of texts becomes one array of code points and one array of row starts. Words, word pairs and
whole texts are hashed through prefix sums of c[i] * B**i modulo 2**64, so that the hash of any span
is one difference and one product, whatever its length.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; x is uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    out = []
    for b in (base, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    return _powers(base, 1 << max(16, int(n).bit_length()))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and the row starts (one more than there are texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


class SpanHash:
    """Hashes of spans of one array of codes."""

    def __init__(self, codes: np.ndarray, base: int = BASES[0]):
        self.power, self.inverse = powers(base, len(codes) + 1)
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * self.power[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(BASES[1]))


@lru_cache(maxsize=1)
def alnum_table() -> np.ndarray:
    """For each code point, whether it is a letter or digit of any script."""
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def gap_table() -> np.ndarray:
    """False at space, tab, line feed and carriage return, else True."""
    t = np.ones(0x110000, bool)
    t[[32, 9, 10, 13]] = False
    return t


def word_spans(codes: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the longest runs of characters with inside[c], never across rows."""
    keep = inside[codes]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    cuts = starts[1:-1]
    cuts = cuts[cuts < len(codes)]
    first[cuts] = keep[cuts]
    last = keep.copy()
    last[:-1] &= ~keep[1:]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = keep[cuts]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(starts, s, "right") - 1


def pair_sets(texts: list[str], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of adjacent words per text, lower-cased, as hashes: values sorted within each row, and row offsets.

    A hash has its 48 bits at the upper end, so that one sort of row and hash together orders all rows.
    """
    found, sizes = [], [np.zeros(1, np.int64)]
    for k in range(0, len(texts), 1 << 16):
        some = texts[k : k + (1 << 16)]
        codes, starts = code_points([t.lower() for t in some])
        s, e, row = word_spans(codes, starts, inside)
        words = SpanHash(codes).of(s, e)
        follows = row[1:] == row[:-1]
        keys = mix(words[:-1] * np.uint64(3) + mix(words[1:]))[follows] >> np.uint64(16)
        keys |= row[:-1][follows].astype(np.uint64) << np.uint64(48)
        keys.sort()
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        keys = keys[fresh]
        found.append(keys << np.uint64(16))
        sizes.append(np.bincount((keys >> np.uint64(48)).astype(np.int64), minlength=len(some)))
    return np.concatenate(found or [np.zeros(0, np.uint64)]), np.cumsum(np.concatenate(sizes))
