"""Words of whole texts as 64-bit hashes, a block of an Arrow column at a time.

The work inside a task is numpy over the bytes of a block; Spark decides which
rows a task gets.  A word's hash depends on its bytes alone, so it is the same
in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer text is a block of its own.  The arrays
#: over a block take some thirty times as much, and should stay in the cache.
BLOCK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words split at ASCII white space only: ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: ASCII letters and digits and everything beyond ASCII:
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z became a-z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

#: Translation for ``bytes.translate``: the same words, ready for ``split``.
ALNUM_TABLE = bytes(int(_LOWER[b]) if ALNUM[b] else 0x20 for b in range(256))

_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(
    1, 2**63, size=256, dtype=np.uint64
)[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _powers(log_length: int) -> np.ndarray:
    out = np.full(1 << log_length, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def texts(column: pa.Array) -> pa.Array:
    """The column with NULL as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and row starts: (first, last, bytes, cuts).

    ``cuts`` has one more entry than there are rows.
    """
    if not len(column):
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(at, at[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def hash_words(data: np.ndarray, cuts: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word; A-Z count as a-z, no word crosses a cut."""
    inside = chars[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = cuts[cuts < len(data)]
    begin[edges] = inside[edges]
    at = np.flatnonzero(begin)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    where = np.flatnonzero(inside)
    first = np.flatnonzero(begin[where])
    lengths = np.diff(np.append(first, len(where)))
    power = _powers(int(lengths.max()).bit_length())
    values = _BYTE_VALUES[data[where]] * power[where - np.repeat(at, lengths)]
    sums = np.add.reduceat(values, first)
    return at, mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_row(at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """First word of each row, and the number of words at the end."""
    return np.searchsorted(at, cuts)
