"""Word-shingle sets of texts, hashed in numpy on the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

#: Work on texts of about this many bytes at a time (a longer text is a piece of its own).
PIECE_BYTES = 1 << 20


def mix(x):
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Polynomial hashes modulo 2^64 of any slice of a sequence of small integers."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, symbols: int = 256):
        self.codes = mix(np.arange(1, symbols + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 2 * len(self.up))
            inverse = pow(self.BASE, -1, 1 << 64)
            for name, base in (("up", self.BASE), ("down", inverse)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def sums(self, codes):
        """Prefix sums for slices(); codes: hashed symbols (self.codes[symbols])."""
        self._grow(len(codes))
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.up[:len(codes)], out=out[1:])
        return out

    def slices(self, sums, start, end):
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A"):ord("Z") + 1] += 32
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    return lower, space


class Shingler:
    """Sets of distinct `width`-word shingles: words are runs of bytes other than space and 0x09-0x0D,
    A-Z lower-cased. Fewer words form one shingle together; no word, no shingle."""

    def __init__(self, width: int = 5):
        self.width, self.hasher = width, Hasher()
        self.lower, self.space = _tables()

    def sets(self, column):
        """For an Arrow string array, yield (row, sorted distinct uint64 shingles) for every row; null is empty."""
        import pyarrow as pa
        column = column.cast(pa.large_string()).fill_null("")
        n = len(column)
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        first = 0
        while first < n:
            last = int(np.searchsorted(offsets, offsets[first] + PIECE_BYTES, "right")) - 1
            last = min(n, max(first + 1, last))
            yield from self._piece(first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            first = last

    def _piece(self, row, data, bounds):
        docs = len(bounds) - 1
        none = np.zeros(0, np.uint64)
        inside = ~self.space[data]
        if not inside.any():
            for i in range(docs):
                yield row + i, none
            return
        edge = np.zeros(len(data) + 1, bool)
        edge[bounds] = True
        before = np.concatenate([[False], inside[:-1]])
        start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.concatenate([inside[1:], [False]])
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        sums = self.hasher.sums(self.hasher.codes[self.lower[data]])
        words = self.hasher.slices(sums, start, end)
        firsts = np.searchsorted(start, bounds)
        many = np.uint64(0xC2B2AE3D27D4EB4F)
        k = self.width
        windows = max(0, len(words) - k + 1)
        grams = np.zeros(windows, np.uint64)
        for j in range(k):
            grams = grams * many + words[j:j + windows]
        grams = mix(grams)
        for i in range(docs):
            a, b = firsts[i], firsts[i + 1]
            if b - a >= k:
                s = np.sort(grams[a:b - k + 1])
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                h = np.array([b - a], np.uint64)
                for j in range(a, b):
                    h = h * many + words[j:j + 1]
                s = mix(h)
            else:
                s = none
            yield row + i, s
