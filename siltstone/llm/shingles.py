"""Word shingles of whole texts as sets of 64-bit hashes, and their MinHash signatures.

A-Z are lower-cased; words are the runs between the white space bytes 0x20 and 0x09-0x0D. A set holds the distinct
shingles of ``width`` words; a text with fewer words has its whole sequence as one; a text without words has none.
Words hash multilinearly over their bytes, shingles over their words, so two different shingles share a hash with a
probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on nothing but the seed and their place."""
    return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15)) | U(1)


def word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts in order, and where each text's words begin (one more entry at the end)."""
    data = np.frombuffer(b" ".join(parts), dtype=np.uint8)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    value = constants(11, 256)[lower]
    is_space = np.zeros(256, dtype=bool)
    is_space[[0x20, *range(0x09, 0x0E)]] = True
    space = is_space[data]
    solid = np.flatnonzero(~space)
    if not len(solid):
        return np.empty(0, dtype=U), np.zeros(len(parts) + 1, dtype=np.int64)
    first = np.concatenate([[True], np.diff(solid) > 1])
    heads = np.flatnonzero(first)
    starts = solid[heads]
    sizes = np.diff(np.concatenate([heads, [len(solid)]]))
    place = np.arange(len(solid)) - np.repeat(heads, sizes)
    multiplier = constants(12, int(sizes.max()))
    words = mix(np.add.reduceat(value[data[solid]] * multiplier[place], heads) + sizes.astype(U))
    return words, np.searchsorted(starts, begins)


def shingle_sets(parts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, edge = word_hashes(parts)
    weights = constants(13, width)
    n = len(words)
    full = np.zeros(max(0, n - width + 1), dtype=U)
    for j in range(width):
        full += words[j : n - width + 1 + j] * weights[j] if len(full) else U(0)
    full = mix(full)
    for s, e in zip(edge[:-1], edge[1:]):
        if e - s >= width:
            yield np.unique(full[s : e - width + 1])
        elif e > s:
            yield mix((words[s:e] * weights[: e - s]).sum(keepdims=True) + U(e - s))
        else:
            yield np.empty(0, dtype=U)


class MinHash:
    """``bands`` times ``rows`` minima of universal hash functions a*x+b modulo 2**32.

    Two sets of similarity s share no band with probability (1 - s**rows)**bands: 4e-7 for 0.85 and 7e-5 for 0.8
    with 25 bands of 5 rows; operators take more bands for a lower threshold.
    """

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.size = bands, rows, bands * rows
        self.a = (constants(21, self.size) >> U(32)).astype(np.uint32) | np.uint32(1)
        self.b = (constants(22, self.size) >> U(32)).astype(np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> U(32)).astype(np.uint32)
        out = np.full(self.size, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), 1024):
            part = self.a[:, None] * x[None, i : i + 1024]
            part += self.b[:, None]
            np.minimum(out, part.min(axis=1), out=out)
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each band."""
        m = minima.reshape(self.bands, self.rows).astype(U)
        return mix((mix(m) * constants(23, self.rows)).sum(axis=1) + constants(24, self.bands)).view(np.int64)


def sizes_of_intersections(one: np.ndarray, many: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many elements of each run of ``many`` (runs begin at ``begins``, none is empty) are in the sorted ``one``."""
    at = np.searchsorted(one, many)
    at[at == len(one)] = 0
    return np.add.reduceat((one[at] == many).astype(np.int64), begins)
