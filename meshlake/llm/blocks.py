"""Rows that are compressed blocks of many records: Spark partitions, shuffles and groups them, numpy works on their arrays."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

from .textbytes import mix

BLOCKS = "bucket int, payload binary"
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What operators keep in a worker from one task of theirs to the next.
CACHES: list[dict] = []


def give_back(keep: dict | None = None) -> None:
    """Returns what a task has freed to the system, and what other operators keep: a worker lives on through many stages, and their tasks need the memory."""
    for cache in CACHES:
        if cache is not keep:
            cache.clear()
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def packed(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpacked(payload: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers by significance, so that equal high bytes compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def numbers_of(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def doc_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def by_bucket(bucket: np.ndarray):
    """(bucket, indexes) for every bucket that occurs."""
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    return zip(names.tolist(), np.split(order, starts[1:]))


def block_rows(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int32()), pa.array([p for _, p in found], pa.binary())], ["bucket", "payload"])


def alone(keys: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first row of each key, number of the key's rows by their index). Rows of one key have the same values."""
    _, first, which, many = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if any((x != x[first][which]).any() for x in same):
        raise ValueError("two different rows have the same 64-bit key")
    order = np.argsort(first)
    return first[order], many[order]


def first_rows(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch without repeated rows, and how often each of them occurs."""
    first, many = alone(batch.column("key").to_numpy(), batch.column("id").to_numpy())
    return (batch if len(first) == batch.num_rows else batch.take(pa.array(first))), many


def sent_texts(n: int):
    """Blocks of whole documents by their key; equal rows of a batch are sent once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            batch, many = first_rows(batch)
            keys, ids = batch.column("key").to_numpy(), batch.column("id").to_numpy()
            texts = batch.column("text").cast(pa.large_binary())
            _, ends, data = texts.buffers()
            ends = np.frombuffer(ends, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
            view = memoryview(data) if data is not None else memoryview(b"")
            if len(ids):
                yield block_rows([(b, packed(keys[i], ids[i], many[i], np.diff(ends)[i], b"".join(view[ends[k] : ends[k + 1]] for k in i))) for b, i in by_bucket(doc_bucket(keys, n))])
        give_back()

    return send


def texts_of(payloads) -> tuple[np.ndarray, ...]:
    """(keys, ids, number of equal rows, offsets, data) of the documents in blocks; of equal rows there is one."""
    parts = [unpacked(p) for p in payloads]
    keys, ids, many, sizes = (np.concatenate([p[k] for p in parts]) for k in range(4))
    data = np.frombuffer(b"".join(p[4] for p in parts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    first, _ = alone(keys, ids, sizes)
    if len(first) < len(keys):
        total = np.zeros(len(first), np.int64)
        order = np.argsort(keys[first], kind="stable")
        np.add.at(total, order[np.searchsorted(keys[first], keys, sorter=order)], many)
        offsets, data = picked(offsets, data, first)
        keys, ids, many = keys[first], ids[first], total
    return keys, ids, many, offsets, data


def picked(offsets: np.ndarray, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of the documents with these indexes."""
    view = memoryview(data)
    text = b"".join(view[offsets[i] : offsets[i + 1]] for i in at)
    return np.concatenate([[0], np.cumsum(np.diff(offsets)[at])]), np.frombuffer(text, np.uint8)


def runs_of(offsets: np.ndarray, use: np.ndarray, most: int = 1 << 20):
    """(first, last + 1) of runs of neighbouring documents in use, each of about `most` bytes."""
    at = np.flatnonzero(use)
    if not len(at):
        return
    a = at[0]
    last = a
    for i in at[1:]:
        if i != last + 1 or offsets[i] - offsets[a] > most:
            yield a, last + 1
            a = i
        last = i
    yield a, last + 1
