"""Terms of texts: maximal runs of ASCII letters, digits and characters beyond ASCII, with only A-Z lower-cased, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .textbytes import LOWER, prefix_hashes, span_hashes

IS_TERM = np.arange(256) >= 128
IS_TERM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of marked bytes; offsets has the first byte of each row and the end of the last. A run ends where its row does."""
    marked = np.zeros(len(inside) + 2, bool)
    marked[1:-1] = inside
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(marked[1:] & (cut | ~marked[:-1]))
    ends = np.flatnonzero(marked[:-1] & (cut | ~marked[1:]))
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term, in the order of the text."""
    starts, ends, rows = runs(IS_TERM[data], offsets)
    return rows, span_hashes(prefix_hashes(LOWER[data]), starts, ends)
