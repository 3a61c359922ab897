"""Vectorised word arithmetic on Arrow string columns: word bounds, word hashes and n-gram hashes.

A word is a run of bytes other than 0x20 and 0x09-0x0D. These are ASCII, so cutting UTF-8 at them
never splits a code point. Hashes are 64-bit prefix-sum polynomials through a random byte table,
then mixed; they depend on the words alone, not on their place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Pattern of a word, for Python's re, Java and RE2 alike.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that are taken at a time; longer documents go alone.
CHUNK_BYTES = 1 << 20
#: Bytes or words whose sums are formed at a time, so that no table grows with the longest text.
BLOCK = 1 << 16

_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_BYTE_VALUES = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Other values of the bytes, for a second hash of the same words.
OTHER_VALUES = np.random.default_rng(20240502).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown to the largest block."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_ODD), _Powers(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a uint64 over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def utf8_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.cast(pa.large_string()).chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of some documents: byte bounds, and first[d]:first[d + 1] are the words of document d."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~_IS_SEPARATOR[data]
    n = len(data)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts_here, ends_here = inside.copy(), inside.copy()
    starts_here[1:] &= ~inside[:-1] | edge[1:n]
    ends_here[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def _long_span(values: np.ndarray) -> np.uint64:
    """The sum that span_hashes() mixes, of one span longer than a block."""
    up, _ = _BYTE_POWERS.get(BLOCK + 1)
    out, scale = 0, 1
    for i in range(0, len(values), BLOCK):
        part = values[i : i + BLOCK]
        out = (out + int(np.sum(part * up[: len(part)], dtype=np.uint64)) * scale) % (1 << 64)
        scale = scale * pow(_ODD, len(part), 1 << 64) % (1 << 64)
    return np.uint64(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """Hashes of spans that are ordered and don't overlap."""
    up, down = _BYTE_POWERS.get(BLOCK + 1)
    out, i = np.empty(len(starts), dtype=np.uint64), 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK, "right")))
        part = values[data[a : ends[j - 1]]]
        if len(part) > BLOCK:
            out[i] = _long_span(part)
        else:
            sums, here = _prefix(part * up[: len(part)]), starts[i:j] - a
            out[i:j] = (sums[ends[i:j] - a] - sums[here]) * down[here]
        i = j
    return mix(out)


def word_hashes(w: Words, lower: bool = False, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    return span_hashes(LOWER[w.data] if lower else w.data, w.starts, w.ends, values)


def gram_hashes(hashes: np.ndarray, w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions where n words of one document start, and the hashes of those n words."""
    counts = np.maximum(w.counts - n + 1, 0)
    total = int(counts.sum())
    begin = np.repeat(w.first[:-1] - (np.cumsum(counts) - counts), counts)
    at = np.arange(total) + begin
    size = max(BLOCK, n)
    up, down = _WORD_POWERS.get(size + n + 1)
    out, i = np.empty(total, dtype=np.uint64), 0
    while i < total:
        a = at[i]
        j = int(np.searchsorted(at, a + size))
        part = hashes[a : at[j - 1] + n]
        sums, here = _prefix(part * up[: len(part)]), at[i:j] - a
        out[i:j] = (sums[here + n] - sums[here]) * down[here]
        i = j
    return at, mix(out)


def sums_by_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for every d."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
