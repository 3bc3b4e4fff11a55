"""Words of a column of texts as numpy arrays, a bounded slice of an Arrow batch at a time.

A word is a run of bytes that are no separators. Every word gets a 64-bit hash that depends on its bytes
only, so hashes agree between tasks, machines and runs. Windows of words are hashed from the word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = bytes([0x20, *range(0x09, 0x0E)])
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum())
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def keys(n: int, seed: int) -> np.ndarray:
    """``n`` odd multipliers of a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(seed)) | np.uint64(1)


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


_LETTERS = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA5A5))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """The first powers of a base, kept for the next slice."""
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers[name][:n]


def _run_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run ``values[start:end]`` that does not depend on where it stands."""
    sums = np.empty(len(values) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values * _power("up", _BASE, len(values)), dtype=np.uint64, out=sums[1:])
    down = _power("down", pow(_BASE, -1, 1 << 64), len(values) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """The words of rows ``first`` to ``first + n`` of a batch, in order."""

    first: int
    n: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.n)

    def bounds(self) -> np.ndarray:
        """The index of each row's first word, and the number of words at the end."""
        return np.concatenate([[0], np.cumsum(self.counts())]).astype(np.int64)

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``size`` words of one row."""
        n = len(self.row) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        return at, self.window_hashes(at, size, seed)

    def window_hashes(self, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        total = np.zeros(len(at), np.uint64)
        for k, key in enumerate(keys(size, seed)):
            total += (self.hashes[at + k] ^ (self.hashes[at + k] >> np.uint64(29))) * key
        return mix(total)

    def joined(self, to_previous: np.ndarray) -> Words:
        """The same text with some words made one with the word before them in their row."""
        first = np.flatnonzero(~to_previous)
        after = np.append(first[1:], len(self.row))
        hashes = self.hashes[first]
        several = after - first > 1
        hashes[several] = _run_hash(self.hashes, first[several], after[several])
        return Words(self.first, self.n, self.data, self.offsets, self.starts[first], self.ends[after - 1], self.row[first], hashes)

    def sequence_hashes(self) -> np.ndarray:
        """A hash of each row's whole sequence of words."""
        bounds = self.bounds()
        return _run_hash(self.hashes, bounds[:-1], bounds[1:])


def texts_of(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array with 64-bit offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(
    column: pa.Array | pa.ChunkedArray, lower: bool = False, separators: bytes = SPACES, most: int = SLICE_BYTES
) -> Iterator[Words]:
    """The words of a column of texts, in slices of about ``most`` bytes; a longer text is a slice of its own.

    ``lower`` folds A to Z in the hashes; the bytes stay as they are.
    """
    texts = texts_of(column)
    if not len(texts):
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    everything = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.empty(0, np.uint8)
    separate = byte_table(separators)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        data = everything[offsets[first] : offsets[last]]
        bounds = offsets[first : last + 1] - offsets[first]
        yield _words(first, data, bounds, separate, _LETTERS[_LOWER] if lower else _LETTERS)
        first = last


def _words(first: int, data: np.ndarray, offsets: np.ndarray, separate: np.ndarray, letters: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separate[data]
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:]
    ends = inside[:-1] & (~inside[1:] | begins[1:])
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, starts, "right") - 1
    hashes = _run_hash(letters[data], starts, ends)
    return Words(first, len(offsets) - 1, data, offsets, starts, ends, row, hashes)
