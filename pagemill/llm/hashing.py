"""Hashes of words and word windows for whole Arrow batches, without a loop over words.

A word is a run of bytes other than space and 0x09-0x0D. Its hash is a polynomial
in an odd base over random byte values, taken from running sums, so every byte is
touched a few times by numpy and never by Python. A-Z count as a-z if asked.
Texts are handled in slices of about SLICE bytes, which bounds the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 5
U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one to one."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h = h ^ (h >> U(27))
    h = h * U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
LOWER_VALUES = BYTE_VALUES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


class _Powers:
    """Powers of the base and of its inverse, as far as they were needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(0, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * SLICE)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


POWERS = _Powers()


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + size, "right"))
        end = min(max(end - 1, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of each text's first word, with the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    stops[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    up, down = POWERS.get(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum((LOWER_VALUES if lower else BYTE_VALUES)[data] * up[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)
    return mix(hashes), np.searchsorted(starts, offsets).astype(np.int64)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive words, also across texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = hashes[:n].copy()
    for k in range(1, size):
        out = mix(out * U(0xC2B2AE3D27D4EB4F) + hashes[k : n + k])
    return out


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For every text its sorted distinct windows; a shorter text is one window,
    a text without words has none."""
    for first, end, data, offsets in slices(texts):
        hashes, at = words(data, offsets, True)
        made = windows(hashes, size)
        for i in range(end - first):
            a, b = at[i], at[i + 1]
            if b - a >= size:
                yield np.unique(made[a : b - size + 1])
            elif b > a:
                yield windows(hashes[a:b], int(b - a))
            else:
                yield hashes[:0]
