"""Words, shapes and hashes of whole Arrow batches of text, computed on the UTF-8 bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd base of the polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once, so that the arrays of a chunk stay in the cache. A longer text is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes takes the hash of any span of data."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def chunks(batch: pa.RecordBatch, column: str, most_rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, offsets of the rows in these bytes). The column has no nulls."""
    values = batch.column(column).cast(pa.large_string())
    if not len(values):
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(data or b"", np.uint8)
    a = 0
    while a < len(values):
        b = min(a + most_rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of bytes other than ASCII white space; runs end where their row does."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(IS_SPACE[data], out=word[1:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cut))
    ends = np.flatnonzero(word[:-1] & (~word[1:] | cut))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def distinct_pairs(rows: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (row, value), sorted; values have so many bits."""
    keys = (rows.astype(np.uint64) << np.uint64(bits)) | values.astype(np.uint64)
    if len(rows) and int(rows.max()) < 1 << (32 - bits):
        keys = keys.astype(np.uint32)
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    keys = keys.astype(np.uint64)
    return (keys >> np.uint64(bits)).astype(np.int64), (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
