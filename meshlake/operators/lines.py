"""Operators that go along the lines of a grid: Fourier transforms and cubic splines, one axis after another.

The cells of a line are gathered as one row of arrays, numpy works on the rows of a
batch, and the result is cells again; then a shuffle turns to the next axis. Each
cell is one row before and after, and a task holds a batch of lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a task works on at once.
CELLS = 1 << 20


def along(df: DataFrame, keys: list[str], axis: str, n: int, values: list[str], change: Callable[[np.ndarray], np.ndarray], keep: list[int] | None = None) -> DataFrame:
    """(keys, axis, values) with lines along an axis of n cells changed by a function of (lines, n, values); absent cells count 0.

    `keep` lists the places of the result that are wanted; the others are not sent on."""
    lines = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).cast("int").alias("at"), *(F.col(v).cast("double").alias(v) for v in values)))).alias("_line"))
    places = list(range(n)) if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, max(1, CELLS // n)):
                part = batch.slice(first, max(1, CELLS // n))
                column = part.column("_line")
                row = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(column).to_numpy())
                cells = column.flatten()
                grid = np.zeros((part.num_rows, n, len(values)))
                at = cells.field("at").to_numpy()
                inside = (at >= 0) & (at < n)
                grid[row[inside], at[inside]] = np.stack([cells.field(v).to_numpy(zero_copy_only=False) for v in values], 1)[inside]
                out = change(grid)[:, places]
                which = pa.array(np.repeat(np.arange(part.num_rows), len(places)))
                arrays = [part.column(k).take(which) for k in keys] + [pa.array(np.tile(np.array(places, np.int32), part.num_rows))] + [pa.array(np.ascontiguousarray(out[:, :, j]).ravel()) for j in range(len(values))]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, axis, *values])

    kinds = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{axis}` int", *(f"`{v}` double" for v in values)])
    return lines.mapInArrow(run, schema)


def _transform(inverse: bool) -> Callable[[np.ndarray], np.ndarray]:
    def change(grid: np.ndarray) -> np.ndarray:
        x = grid[:, :, 0] + 1j * grid[:, :, 1]
        x = np.fft.ifft(x, axis=1) if inverse else np.fft.fft(x, axis=1)
        return np.stack([x.real, x.imag], 2)

    return change


def fourier(df: DataFrame, keys: list[str], shape: dict[str, int], inverse: bool = False, keep: dict[str, list[int]] | None = None, parts: tuple[str, str] = ("re", "im")) -> DataFrame:
    """(keys, axes, re, im): the discrete Fourier transform of values (re, im) along all axes of a grid, axis by axis."""
    out = df
    for axis, n in shape.items():
        others = [c for c in shape if c != axis]
        out = along(out, [*keys, *others], axis, n, list(parts), _transform(inverse), (keep or {}).get(axis))
    return out.select(*keys, *shape, *parts)


def low_pass(df: DataFrame, keys: list[str], shape: dict[str, int], radius: float) -> DataFrame:
    """(keys, axes, val): images or volumes without frequencies beyond a radius, counted in periods over the grid; absent cells count 0.

    Frequencies beyond the radius along one axis are dropped as soon as that axis is transformed."""
    near = {a: [k for k in range(n) if min(k, n - k) <= radius] for a, n in shape.items()}
    parts = ("_re", "_im")
    x = fourier(df.select(*keys, *shape, F.col("val").alias("_re"), F.lit(0.0).alias("_im")), keys, shape, keep=near, parts=parts)
    distance = sum(F.pow(F.least(F.col(a), F.lit(n) - F.col(a)).cast("double"), 2) for a, n in shape.items())
    back = fourier(x.where(distance <= radius * radius), keys, dict(reversed(shape.items())), inverse=True, parts=parts)
    return back.select(*keys, *shape, F.col("_re").alias("val"))


def motion(df: DataFrame, keys: list[str], time: str, steps: int) -> DataFrame:
    """(keys, motion): the magnitudes of a cell's Fourier terms over time, without the constant one, summed. Absent steps count 0."""

    def change(grid: np.ndarray) -> np.ndarray:
        return np.abs(np.fft.fft(grid[:, :, 0], axis=1))[:, 1:].sum(1)[:, None, None]

    out = along(df.select(*keys, time, F.col("val").alias("motion")), keys, time, steps, ["motion"], lambda g: np.repeat(change(g), g.shape[1], 1), [0])
    return out.select(*keys, "motion")


#: The pole of the cubic B-spline filter.
POLE = 3**0.5 - 2


def _prefilter(grid: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-splines through values with mirrored ends: one recursive filter forward, one back."""
    x = grid[:, :, 0]
    n = x.shape[1]
    if n == 1:
        return grid
    c = 6 * x
    powers = POLE ** np.arange(n)
    # The sum of the mirrored signal, closed: its period is 2n - 2.
    first = c[:, 0] + POLE ** (n - 1) * c[:, n - 1] + (c[:, 1 : n - 1] * (powers[1 : n - 1] + POLE ** (2 * n - 2) / powers[1 : n - 1])).sum(1)
    out = np.empty_like(c)
    out[:, 0] = first / (1 - POLE ** (2 * n - 2))
    for k in range(1, n):
        out[:, k] = c[:, k] + POLE * out[:, k - 1]
    out[:, n - 1] = POLE / (POLE * POLE - 1) * (out[:, n - 1] + POLE * out[:, n - 2])
    for k in range(n - 2, -1, -1):
        out[:, k] = POLE * (out[:, k + 1] - out[:, k])
    return out[:, :, None]


def spline_coefficients(df: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """(keys, row, col, val): the coefficients of the cubic B-spline surface through images; absent pixels count 0."""
    down = along(df.select(*keys, "row", "col", "val"), [*keys, "col"], "row", rows, ["val"], _prefilter)
    return along(down, [*keys, "row"], "col", cols, ["val"], _prefilter).select(*keys, "row", "col", "val")


def spline_samples(coefficients: DataFrame, places: DataFrame, keys: list[str], ids: list[str], rows: int, cols: int) -> DataFrame:
    """(keys, ids, val): the surface at places (keys, ids, y, x) in pixels; 0 outside the image. A place meets its 4 × 4 coefficients, mirrored at the edges."""
    base = {"y": F.floor("y"), "x": F.floor("x")}

    def weight(t, k):
        u = 1 - t
        return (u * u * u / 6, (3 * t * t * t - 6 * t * t + 4) / 6, (3 * u * u * u - 6 * u * u + 4) / 6, t * t * t / 6)[k]

    def mirrored(c, n):
        return F.lit(0) if n == 1 else (n - 1) - F.abs(F.pmod(c, F.lit(2 * n - 2)) - (n - 1))

    inside = F.col("y").between(0, rows - 1) & F.col("x").between(0, cols - 1)
    pieces = F.array(*(F.struct(mirrored(base["y"] + j - 1, rows).cast("int").alias("row"), mirrored(base["x"] + i - 1, cols).cast("int").alias("col"), (weight(F.col("y") - base["y"], j) * weight(F.col("x") - base["x"], i)).alias("w")) for j in range(4) for i in range(4)))
    wide = places.where(inside).select(*keys, *ids, F.explode(pieces).alias("s")).select(*keys, *ids, "s.*")
    sums = wide.join(coefficients, [*keys, "row", "col"], "left").groupBy(*keys, *ids).agg(F.sum(F.col("w") * F.coalesce("val", F.lit(0.0))).alias("val"))
    return places.select(*keys, *ids).join(sums, [*keys, *ids], "left").select(*keys, *ids, F.coalesce("val", F.lit(0.0)).alias("val"))


def zoomed(field: DataFrame, keys: list[str], shape: tuple[int, int], rows: int, cols: int) -> DataFrame:
    """(keys, row, col, val): a small field (keys, row, col, val) of a shape stretched over rows × cols by its spline surface, ends on ends."""
    place = lambda c, a, b: F.least(F.lit(float(a - 1)), F.col(c) * ((a - 1) / (b - 1) if b > 1 else 0.0))
    count = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    places = field.select(*keys).distinct() if keys else field.sparkSession.range(1).select()
    places = places.withColumn("row", count(rows)).withColumn("col", count(cols))
    places = places.withColumns({"y": place("row", shape[0], rows), "x": place("col", shape[1], cols)}).withColumnsRenamed({"row": "_row", "col": "_col"})
    found = spline_samples(spline_coefficients(field, keys, *shape), places, keys, ["_row", "_col"], *shape)
    return found.withColumnsRenamed({"_row": "row", "_col": "col"})


def warp(df: DataFrame, shifts: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """(keys, row, col, val): images read at displaced places, pixel (row, col) from (row + dy, col + dx) of the spline surface; 0 from outside. shifts: (keys, row, col, dy, dx), one for each pixel that is wanted."""
    places = shifts.select(*keys, F.col("row").alias("_row"), F.col("col").alias("_col"), (F.col("row") + F.col("dy")).alias("y"), (F.col("col") + F.col("dx")).alias("x"))
    found = spline_samples(spline_coefficients(df, keys, rows, cols), places, keys, ["_row", "_col"], rows, cols)
    return found.withColumnsRenamed({"_row": "row", "_col": "col"})
