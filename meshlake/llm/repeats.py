"""A Bloom filter of the keys that rows repeat, and joins with groups of which a few may be very large.

The filter has counters that stop at two. Every task counts the cells that its
rows set; the counts of a block of cells are merged in two levels, so that no
task gathers a block from all tasks at once. A key of two or more rows has all
its cells set twice; a key of one row may have that by chance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Cells of a block of the filter; a row's cells all lie in one block.
BLOCK = 1 << 16


def _counted(once: np.ndarray, more: np.ndarray) -> tuple[bytes, bytes]:
    seen = np.minimum(np.bincount(once, minlength=BLOCK) + 2 * np.bincount(more, minlength=BLOCK), 2)
    return tuple(np.flatnonzero(seen == k).astype("<u2").tobytes() for k in (1, 2))


def _count_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task and block: the cells set once and those set more than once."""
    parts = [(b.block.to_numpy(), b.one.to_numpy(), b.two.to_numpy()) for b in batches]
    if not parts:
        return
    block, one, two = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(block, kind="stable")
    block, one, two = block[order], one[order], two[order]
    names, starts = np.unique(block, return_index=True)
    out = []
    for name, a, b in zip(names, starts, [*starts[1:], len(block)]):
        out.append((int(name), *_counted(np.concatenate([one[a:b], two[a:b]]), np.zeros(0, int))))
    yield pd.DataFrame(out, columns=["block", "once", "more"])


def _cell_arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(pdf[c]), "<u2") for c in ("once", "more"))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once, more = _counted(*_cell_arrays(pdf))
    return pd.DataFrame({"block": [pdf.block.iloc[0]], "once": [once], "more": [more]})


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    _, more = _counted(*_cell_arrays(pdf))
    bits = np.zeros(BLOCK, "u1")
    bits[np.frombuffer(more, "<u2")] = 1
    return pd.DataFrame({"block": [pdf.block.iloc[0]], "words": [np.packbits(bits, bitorder="little").view("<i8")]})


def repeated_filter(cells: DataFrame, salts: int = 16) -> DataFrame:
    """(block, words): bit sets of the cells that at least two rows of (block, one, two) set."""
    schema = "block long, once binary, more binary"
    local = cells.select("block", "one", "two").mapInPandas(_count_cells, schema)
    merged = local.groupBy("block", (F.spark_partition_id() % salts).alias("salt")).applyInPandas(_merge, schema)
    return merged.groupBy("block").applyInPandas(_repeated, "block long, words array<bigint>")


def marked_repeats(df: DataFrame, key: Column, rows: int, bits_per_row: int, max_bits: int) -> DataFrame:
    """df with `maybe`, false only where no other row has the same key (64 bits). The filter that is broadcast has at most max_bits bits."""
    n_blocks = min(max_bits, 1 << math.ceil(math.log2(max(1, rows) * bits_per_row))) // BLOCK or 1
    part = lambda bits, width: F.shiftrightunsigned(key, bits).bitwiseAND(F.lit((1 << width) - 1))
    one, two = part(0, 16).cast("int"), part(16, 16).cast("int")
    cells = df.withColumns({"block": part(32, 31) % n_blocks, "one": one, "two": F.when(one == two, one.bitwiseXOR(F.lit(1))).otherwise(two)})
    repeated = written(repeated_filter(cells))
    hit = lambda c: F.getbit(F.get("words", (F.col(c) / 64).cast("int")), F.col(c) % 64) == 1
    probed = cells.join(F.broadcast(repeated), "block", "left")
    return probed.select(*df.columns, F.coalesce(hit("one") & hit("two"), F.lit(False)).alias("maybe"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, large: int = 1000) -> DataFrame:
    """rows joined with groups by key. Groups of more than total / large rows are fewer than `large`: they are broadcast, so their rows stay where they are; the rest shuffles."""
    hot = F.broadcast(groups.where(F.col(size) * large > total))
    cold = groups.where(F.col(size) * large <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
