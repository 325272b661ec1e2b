"""Vectorised rolling hashes over the words of many texts at once.

A batch of texts becomes one byte array in which the words of a text are parted by one space. The hash of a byte range
is its polynomial over the field of 2**31 - 1 elements at two bases, 62 bits in all, read from prefix sums in a few
gathers. Equal word runs have equal hashes wherever they stand. Two different ranges of n bytes share a hash for at most
n of the field's elements at either base, whatever their pattern. Hashes only propose: where a result depends on equal
words, operators compare SHA-256 digests of the words or the words themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np

U = np.uint64
#: Texts are hashed in groups of about this many bytes, which bounds the memory of a worker. A longer text stands alone
#: and takes about 50 bytes of memory for each of its own.
BATCH_BYTES = 1 << 20
FIELD = (1 << 31) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64), so that their order and low bits look random."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed << 32)) * U(0x9E3779B97F4A7C15))


def fold(x: np.ndarray) -> np.ndarray:
    """A smaller value of the same remainder by FIELD."""
    return (x & U(FIELD)) + (x >> U(31))


class Roller:
    """Hashes byte ranges with one seed; keeps the powers of its bases between batches."""

    def __init__(self, seed: int = 1):
        self.bases = [int(b) % (FIELD - 3) + 2 for b in stream(seed + 1000, 2)]
        self.up = self.down = [np.ones(1, np.uint32)] * 2

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint32)
        size = 1
        while size < n:
            end = min(n, 2 * size)
            x = fold(fold(out[: end - size].astype(U) * U(pow(base, size, FIELD))))
            out[size:end] = np.where(x >= FIELD, x - U(FIELD), x)
            size *= 2
        return out

    def prefix(self, data: np.ndarray) -> list[np.ndarray]:
        """For each base: sums of byte values times powers of the base, up to each place. Terms are below 2**40, folded
        below 2**33 where there are so many that a sum could overflow."""
        n = len(data) + 1
        if len(self.up[0]) < n:
            size = 1 << n.bit_length()
            self.up = [self._powers(b, size) for b in self.bases]
            self.down = [self._powers(pow(b, -1, FIELD), size) for b in self.bases]
        value, out = data.astype(U) + U(1), []
        for up in self.up:
            sums = np.empty(n, U)
            sums[0] = 0
            np.multiply(value, up[: n - 1], out=sums[1:])
            if n > 1 << 23:
                sums = fold(sums)
            out.append(np.cumsum(sums, out=sums))
        return out

    def ranges(self, prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        both = np.zeros(len(starts), U)
        for sums, down in zip(prefix, self.down, strict=True):
            x = fold(fold(sums[ends] - sums[starts])) * down[starts]
            x = fold(fold(x))
            both = both << U(31) | np.where(x >= FIELD, x - U(FIELD), x)
        return mix(both)


def digests(parts: Iterable[bytes | memoryview]) -> np.ndarray:
    """The first 128 bits of SHA-256 of each part, as two signed whole numbers: what is taken for the part itself."""
    return np.frombuffer(b"".join([hashlib.sha256(p).digest()[:16] for p in parts]), "<i8").reshape(-1, 2)


class Words:
    """Word positions of a batch: bytes `data`, word byte ranges, and for each text its first word and word count."""

    def __init__(self, texts: list[bytes]):
        joined = [b" ".join(t.split()) for t in texts]
        sizes = np.fromiter(map(len, joined), np.int64, len(joined))
        self.data = np.frombuffer(b" ".join(joined) + b" ", np.uint8)
        begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        gaps = np.flatnonzero(self.data == 32)
        # an empty text leaves a gap at its own begin, which ends no word
        starts = np.concatenate([[0], gaps[:-1] + 1]) if len(gaps) else np.zeros(0, np.int64)
        real = gaps > starts
        self.starts, self.ends = starts[real], gaps[real]
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(np.append(self.first, len(self.starts)))

    def grams(self, roller: Roller, k: int, prefix: list[np.ndarray] | None = None) -> np.ndarray:
        """Hash of the k words from each word on; those that cross into the next text are meaningless."""
        if len(self.starts) < k:
            return np.zeros(0, U)
        prefix = roller.prefix(self.data) if prefix is None else prefix
        return roller.ranges(prefix, self.starts[: len(self.starts) - k + 1], self.ends[k - 1 :])

    def whole(self, roller: Roller, prefix: list[np.ndarray]) -> np.ndarray:
        """Hash of each text's whole word sequence; 0 without words."""
        out = np.zeros(len(self.counts), U)
        has = self.counts > 0
        f = self.first[has]
        out[has] = roller.ranges(prefix, self.starts[f], self.ends[f + self.counts[has] - 1])
        return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def batches(sizes: list[int], most: int = BATCH_BYTES):
    """Index ranges of about `most` bytes each; a longer text stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
