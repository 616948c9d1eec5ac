"""Directly addressable codes for arrays of token ids.

An id is split into chunks of 8, 8 and 16 bits. A level holds the chunks of the ids that
reach it, one bit for each says whether the id goes on, and a rank directory over those bits
(a count for each 512 bits, and inside them for each 64) gives the place in the next level. So the
id at any position is read with one rank a level and nothing before it is decoded.

Layout, little endian: b"DAC1", number of levels (u1), ids (u8); then for each level: bits of a
chunk (u1), chunks (u8), the chunks, and but for the last level the bitmap in 64-bit words,
the counts before each 512 bits (u8) and the counts before each word inside those (u2).
"""

from __future__ import annotations

import struct

import numpy as np

WIDTHS = (8, 8, 16)
MAGIC = b"DAC1"
_KIND = {8: np.dtype("<u1"), 16: np.dtype("<u2"), 32: np.dtype("<u4")}


def _bitmap(more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = np.zeros((len(more) + 511) // 512 * 8, "<u8")
    packed = np.packbits(more, bitorder="little")
    words.view(np.uint8)[: len(packed)] = packed
    counts = np.bitwise_count(words).astype(np.int64).reshape(-1, 8)
    inside = np.cumsum(counts, axis=1) - counts
    blocks = counts.sum(axis=1)
    return words, (np.cumsum(blocks) - blocks).astype("<u8"), inside.astype("<u2").ravel()


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """The code of an array of unsigned integers below 2 ** sum(widths)."""
    left = np.asarray(ids, np.uint64)
    if len(left) and int(left.max()) >> sum(widths):
        raise ValueError(f"an id needs more than {sum(widths)} bits")
    out = [MAGIC, struct.pack("<BQ", len(widths), len(left))]
    for level, width in enumerate(widths):
        chunks = (left & np.uint64((1 << width) - 1)).astype(_KIND[width])
        out += [struct.pack("<BQ", width, len(chunks)), chunks.tobytes()]
        if level < len(widths) - 1:
            left = left >> np.uint64(width)
            more = left > 0
            out += [x.tobytes() for x in _bitmap(more)]
            left = left[more]
    return b"".join(out)


class Reader:
    """Random access to one code."""

    def __init__(self, code: bytes):
        if code[:4] != MAGIC:
            raise ValueError("not a directly addressable code")
        levels, self.n = struct.unpack_from("<BQ", code, 4)
        self.levels = []
        at = 13
        for level in range(levels):
            width, n = struct.unpack_from("<BQ", code, at)
            at += 9
            chunks = np.frombuffer(code, _KIND[width], n, at)
            at += chunks.nbytes
            ranks = None
            if level < levels - 1:
                blocks = (n + 511) // 512
                words = np.frombuffer(code, "<u8", blocks * 8, at)
                before = np.frombuffer(code, "<u8", blocks, at + words.nbytes)
                inside = np.frombuffer(code, "<u2", blocks * 8, at + words.nbytes + before.nbytes)
                at += words.nbytes + before.nbytes + inside.nbytes
                ranks = (words, before, inside)
            self.levels.append((width, chunks, ranks))

    def take(self, positions: np.ndarray) -> np.ndarray:
        """The ids at some positions, in any order."""
        place = np.asarray(positions, np.int64)
        if len(place) and not (0 <= place.min() and place.max() < self.n):
            raise IndexError("a position is outside the code")
        out = np.zeros(len(place), np.uint64)
        row, shift = np.arange(len(place)), 0
        for width, chunks, ranks in self.levels:
            out[row] |= chunks[place].astype(np.uint64) << np.uint64(shift)
            if ranks is None:
                break
            words, before, inside = ranks
            bit = (place & 63).astype(np.uint64)
            word = words[place >> 6]
            on = (word >> bit & np.uint64(1)).astype(bool)
            place, row, bit, word = place[on], row[on], bit[on], word[on]
            low = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            place = before[place >> 9].astype(np.int64) + inside[place >> 6] + low
            shift += width
        return out

    def _rank(self, level: int, at: int) -> int:
        """How many of the first ``at`` ids of a level go on to the next."""
        words, before, inside = self.levels[level][2]
        if at == self.n_of(level):
            return self.n_of(level + 1)
        low = int(words[at >> 6]) & ((1 << (at & 63)) - 1)
        return int(before[at >> 9]) + int(inside[at >> 6]) + low.bit_count()

    def n_of(self, level: int) -> int:
        return len(self.levels[level][1])

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to before ``stop``: a run in each level, found with two ranks."""
        if not 0 <= start <= stop <= self.n:
            raise IndexError("a position is outside the code")

        def run(level: int, lo: int, hi: int) -> np.ndarray:
            width, chunks, ranks = self.levels[level]
            out = chunks[lo:hi].astype(np.uint64)
            if ranks is not None and hi > lo:
                held = ranks[0].view(np.uint8)[lo >> 3 : (hi + 7) >> 3]
                more = np.unpackbits(held, bitorder="little")[lo & 7 : (lo & 7) + hi - lo].view(bool)
                out[more] |= run(level + 1, self._rank(level, lo), self._rank(level, hi)) << np.uint64(width)
            return out

        return run(0, start, stop)
