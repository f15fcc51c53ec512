"""Hashes of words and of runs of words for whole batches of texts, in numpy.

The texts of a batch are laid end to end; a polynomial prefix sum over the bytes gives every word's hash, and one over
the words' hashes gives the hash of any run of words. Arithmetic is modulo 2**64; bases are odd, so they can be divided by.
A hash doesn't depend on the place, so bytes are taken in segments, cut at blanks: a long text needs no more memory than its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTE_BASE, _RUN_BASE, _SECOND_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes that are hashed, and texts that are taken, at a time.
SEGMENT = 1 << 18

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        have = (out[0], out[1])
        if size <= 2 * SEGMENT:  # tables for longer texts aren't kept
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def _segments(buf: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of runs of bytes that begin and end with the same blanks and cut no word; one is longer than SEGMENT only for a longer word."""
    at = 0
    while at < len(buf) - 1:
        end = min(at + SEGMENT, len(buf))
        while not (blanks := np.flatnonzero(_BLANK[buf[at + 1 : end]])).size:
            end = min(end + SEGMENT, len(buf))
        last = at + 1 + int(blanks[-1])
        yield at, last + 1
        at = last


def _hashed(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes."""
    blank = _BLANK[buf]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    up, down = powers(_BYTE_BASE, len(buf))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return starts, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Words:
    """doc: each word's text, by number; first: the number of each text's first word; run(): hashes of runs of words."""

    def __init__(self, texts: list[bytes]):
        buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
        parts = [_hashed(buf[i:j]) + (i,) for i, j in _segments(buf)]
        starts = np.concatenate([p[0] + p[2] for p in parts]) if parts else np.zeros(0, np.int64)
        self.hash = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
        bounds = np.cumsum([1] + [len(t) + 1 for t in texts])  # where each text begins
        self.first = np.searchsorted(starts, bounds)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def run(self, starts: np.ndarray, lengths: np.ndarray | int, second: bool = False) -> np.ndarray:
        """Hashes of the runs of ``lengths`` words from word numbers ``starts`` (equal words and length: equal hash)."""
        base = _SECOND_BASE if second else _RUN_BASE
        if base not in self._sums:
            up, down = powers(base, len(self.hash) + 1)
            self._sums[base] = (np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hash * up[:-1])]), down)
        sums, down = self._sums[base]
        return mix((sums[starts + lengths] - sums[starts]) * down[starts] + np.asarray(lengths).astype(np.uint64))


def text_parts(column: pa.Array, lower: bool = False, most: int = SEGMENT) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, last + 1, texts in UTF-8) of runs of a column that together have about ``most`` bytes; null texts are empty."""
    data = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = done = 0
    while at < len(data):
        to = min(int(np.searchsorted(ends, done + most)) + 1, len(data))
        texts = [x or b"" for x in data.slice(at, to - at).to_pylist()]
        yield at, to, [x.translate(LOWER) for x in texts] if lower else texts
        at, done = to, int(ends[to - 1])


def batches_of(texts: list[bytes], most: int = SEGMENT):
    """(first, last + 1) of runs of texts that together have about ``most`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
