"""Vectorised word scanning over the bytes of Arrow text columns.

All of the hashing operators share this: a batch of texts is taken as one byte
buffer, words are found by a table of 256 byte classes, and each word gets a
64-bit hash from prefix sums of ``value[byte] * BASE**position``.  Nothing is
done per character in Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9DDFEA08EB382D69
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALTS = np.random.default_rng(20240229).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)
_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]``: everything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, a-z and every byte of a non-ASCII character.
NOTICE_WORD = np.zeros(256, dtype=bool)
NOTICE_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SHINGLE = 5
CHUNK_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


@dataclass
class Text:
    """Texts of some rows as one buffer: row ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many of the bytes with a true flag each row has."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def prefix_hash(self, values: np.ndarray = _VALUES) -> np.ndarray:
        up, _ = _POWERS.upto(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum(values[self.data] * up[: len(self.data)], out=out[1:])
        return out


@dataclass
class Words:
    """Words of some rows: byte ranges, and ``first[i]:first[i + 1]`` are the words of row ``i``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Text:
    """The buffer of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(raw) else np.zeros(0, np.uint8)
    return Text(LOWER[data] if lower else data, offsets - offsets[0])


def words_of(text: Text, is_word: np.ndarray = NOT_SPACE) -> Words:
    """All words of all rows; a word never crosses a row."""
    inside = is_word[text.data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = text.offsets[:-1] < text.offsets[1:]
    heads, tails = text.offsets[:-1][full], text.offsets[1:][full] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(start, end, np.searchsorted(start, text.offsets), hash_ranges(text, start, end))


def range_hasher(text: Text) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """:func:`hash_ranges` of a text for several lists of ranges."""
    _, down = _POWERS.upto(len(text.data) + 1)
    sums = text.prefix_hash()
    return lambda start, end: mix((sums[end] - sums[start]) * down[start])


def hash_ranges(text: Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, alike wherever the same bytes stand."""
    return range_hasher(text)(start, end)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` consecutive words, in order."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * _SALTS[k]
    return mix(out)


def row_shingles(hashes: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Shingle hashes of one text in order; a text of fewer words than ``width`` is one shingle; none without words."""
    if len(hashes) == 0:
        return np.zeros(0, dtype=np.uint64)
    if len(hashes) < width:
        n = len(hashes)
        return mix((hashes * _SALTS[:n]).sum(keepdims=True) + np.full(1, n, dtype=np.uint64) * _SALTS[63])
    return window_hashes(hashes, width)


def byte_slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, so that working arrays stay small; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < len(sizes):
        yield batch.slice(begin)


def signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's signed longs."""
    return hashes.view(np.int64)
