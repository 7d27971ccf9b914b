"""Word hashes of whole texts, counted for an Arrow batch at once.

Words are maximal runs of bytes that a separator table does not mark. A word's hash is a polynomial over a fixed
random value per byte, modulo 2**64, then mixed; equal words have equal hashes on every machine. Work memory is bound
by `BLOCK` bytes of text (or the longest word), beside 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def inverse(base: int = _BASE) -> int:
    return pow(base, -1, 1 << 64)


def byte_values(lower: bool, seed: int = 0) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


def separators(keep_marks: bool = True) -> np.ndarray:
    """Bytes between words: ASCII white space, or every ASCII byte that is no letter or digit."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13]] = True
    if not keep_marks:
        table[:128] = ~np.char.isalnum(np.arange(128, dtype=np.uint8).view("S1"))
    return table


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets of each; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


class Words:
    """Hashes words with one byte table and separator table."""

    def __init__(self, lower: bool = False, keep_marks: bool = True, seed: int = 0) -> None:
        self._values, self._breaks = byte_values(lower, seed), separators(keep_marks)
        self._up = self._down = np.zeros(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._up) < n:
            self._up, self._down = powers(n), powers(n, inverse())
        return self._up, self._down

    def _block(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and running sums of the words of one block; `edges` are starts of texts in it."""
        inside = ~self._breaks[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = edges[edges < len(data)]
        starts[edges] = inside[edges]
        edges = edges[edges > 0] - 1
        ends[edges] = inside[edges]
        up, _ = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._values[data] * up[: len(data)], out=sums[1:])
        return np.flatnonzero(starts), np.flatnonzero(ends) + 1, sums

    def blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, starts, ends, sums) per block; blocks end at a text's end or, in a long text, between words."""
        place, stop = int(offsets[0]), int(offsets[-1])
        while place < stop:
            end = min(place + BLOCK, stop)
            if end < stop:
                text = int(np.searchsorted(offsets, end, "right")) - 1
                if offsets[text] > place:
                    end = int(offsets[text])
                else:
                    text_end = int(offsets[text + 1])
                    gaps = np.flatnonzero(self._breaks[data[place:end]])
                    while not len(gaps) and end < text_end:
                        further = min(end + BLOCK, text_end)
                        gaps = np.flatnonzero(self._breaks[data[end:further]]) + (end - place)
                        end = further
                    end = place + int(gaps[-1]) + 1 if len(gaps) else text_end
            low, high = np.searchsorted(offsets, [place, end])
            yield (place, *self._block(data[place:end], offsets[low:high] - place))
            place = end

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of all texts, and n + 1 offsets into them."""
        parts, places = [], []
        for place, starts, ends, sums in self.blocks(data, offsets):
            _, down = self._powers(len(sums))
            parts.append(mix((sums[ends] - sums[starts]) * down[starts]))
            places.append(starts + place)
        if not parts:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return np.concatenate(parts), np.searchsorted(np.concatenate(places), offsets)


def slices(column: pa.Array, size: int = 4 * BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `size` bytes, one row at least."""
    data, offsets = text_buffers(column)
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, data, offsets[low : high + 1]
        low = high


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, at its first word (n at most the number of words)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    if n <= 8:
        factors = powers(n)
        total = hashes[n - 1 :] * factors[n - 1]
        for k in range(n - 1):
            total += hashes[k : len(hashes) - n + 1 + k] * factors[k]
        return mix(total)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(len(hashes) - n + 1, inverse()))
