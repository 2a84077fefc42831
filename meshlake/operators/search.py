"""Search for points in elements of any order: candidates by cells of a grid, coordinates by Newton steps."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from .grid import CELL, box_level, levels_of, with_box_cells, with_point_cells
from .spatial import with_corners
from .stored import stored


def bernstein_matrix(geometry: str, order: int) -> np.ndarray:
    """Control points of an element are this matrix times its nodes. An element lies within the hull of its control points, not of its nodes."""
    powers = np.array(basis.exponents(geometry, order))
    places = basis.node_positions(geometry, order)
    factorial = np.cumprod(np.concatenate([[1.0], np.arange(1.0, order + 1)]))
    if basis.GEOMETRIES[geometry][1]:
        full = np.column_stack([powers, order - powers.sum(1)])
        bary = np.column_stack([places, 1 - places.sum(1)])
        scale = factorial[order] / factorial[full].prod(1)
    else:
        full, bary = np.hstack([powers, order - powers]), np.hstack([places, 1 - places])
        scale = (factorial[order] / (factorial[powers] * factorial[order - powers])).prod(1)
    values = scale * np.prod(bary[:, None, :] ** full[None, :, :], 2)
    return np.linalg.inv(values)


def _starts(geometry: str, level: int) -> np.ndarray:
    """Middles of the 2**level parts an axis of the unit element."""
    dims, simplex = basis.GEOMETRIES[geometry]
    n = 1 << level
    places = (np.array(list(itertools.product(range(n), repeat=dims))) + 0.5) / n
    if simplex and level == 0:
        return np.full((1, dims), 1.0 / (dims + 1))
    return places[places.sum(1) <= 1] if simplex else places


def invert(corners: np.ndarray, points: np.ndarray, geometry: str, order: int, steps: int, levels: int, eps: float) -> np.ndarray:
    """The coordinates of points in their elements, nan where a point lies outside. corners: (n, nodes, 3).

    Newton steps start from the middle of the element. What has not come to the point starts again from the middles of
    its parts, halved level by level; what has come to it outside the element is outside, as elements do not fold."""
    powers = np.array(basis.exponents(geometry, order))
    dims, simplex = basis.GEOMETRIES[geometry]
    # Rows last, so that each operation goes along all of them.
    weights = np.einsum("im,nic->mcn", basis.lagrange_coefficients(geometry, order), corners)
    size = np.maximum(np.ptp(corners, axis=1).max(1), 1e-300)
    out = np.full((len(points), dims), np.nan)

    def terms(xi: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The monomials at places, and their derivatives along each axis."""
        power = np.ones((powers.max() + 1, *xi.shape))
        for k in range(1, len(power)):
            power[k] = power[k - 1] * xi
        of = [power[powers[:, d], d] for d in range(dims)]
        slope = [powers[:, d, None] * power[np.maximum(powers[:, d] - 1, 0), d] for d in range(dims)]
        product = lambda x: reduce(np.multiply, x)
        return product(of), [product([*of[:d], slope[d], *of[d + 1 :]]) for d in range(dims)]

    at = lambda m, w: np.einsum("mn,mcn->cn", m, w)
    todo = np.arange(len(points))
    for level in range(levels + 1):
        for start in _starts(geometry, level):
            if not len(todo):
                return out
            xi, left_over = np.tile(start[:, None], (1, len(todo))), np.arange(len(todo))
            w, p = weights[:, :, todo], points[todo].T
            for _ in range(steps):
                value, slopes = terms(xi[:, left_over])
                off, slope = at(value, w) - p, np.stack([at(m, w) for m in slopes])
                # Least squares: the same as the inverse for volumes, and it serves surfaces and lines.
                left = np.einsum("dcn,ecn->nde", slope, slope)
                right = np.einsum("dcn,cn->nd", slope, off)
                damp = 1e-30 + 1e-14 * np.trace(left, axis1=1, axis2=2)
                left = left + damp[:, None, None] * np.eye(dims)
                new = np.clip(xi[:, left_over] - np.linalg.solve(left, right[:, :, None])[:, :, 0].T, -1.0, 2.0)
                # What no longer moves has come to its place, or to a bound where it would stay.
                moved = np.abs(new - xi[:, left_over]).max(0) > 1e-14
                xi[:, left_over] = new
                left_over, w, p = left_over[moved], w[:, :, moved], p[:, moved]
                if not len(left_over):
                    break
            off = np.abs(at(terms(xi)[0], weights[:, :, todo]) - points[todo].T).max(0)
            inside = (xi >= -eps).all(0) & ((xi.sum(0) <= 1 + eps) if simplex else (xi <= 1 + eps).all(0))
            close = off <= max(eps, 1e-9) * size[todo]
            out[todo[close & inside]] = xi[:, close & inside].T
            todo = todo[~close]
    return out


def _corners(column: pa.Array, rows: int) -> np.ndarray:
    """Arrays of as many points in each of `rows` rows, as (rows, points, 3); nan for nulls."""
    return np.stack([c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten()], 1).astype(float).reshape(rows, -1, 3)


def _boxes(geometry: str, order: int):
    """The boxes of the control points of elements with all their nodes, in single precision and rounded outwards: they only choose candidates."""
    matrix = bernstein_matrix(geometry, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.compute.equal(pa.compute.list_value_length(batch.column("cnodes")), len(matrix)))
            if not batch.num_rows:
                continue
            hull = np.einsum("mn,enc->emc", matrix, _corners(batch.column("cnodes"), batch.num_rows))
            batch, hull = batch.filter(pa.array(np.isfinite(hull).all((1, 2)))), hull[np.isfinite(hull).all((1, 2))]
            low = np.nextafter(hull.min(1).astype(np.float32), np.float32(-np.inf))
            high = np.nextafter(hull.max(1).astype(np.float32), np.float32(np.inf))
            yield pa.RecordBatch.from_arrays([batch.column("elem_id"), *(pa.array(np.ascontiguousarray(side[:, c])) for side in (low, high) for c in range(3))], ["elem_id", *BOX])

    return run


BOX = ["_ax", "_ay", "_az", "_bx", "_by", "_bz"]


def _inverted(geometry: str, order: int, steps: int, levels: int, eps: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = np.stack([batch.column("p").field(c).to_numpy(zero_copy_only=False) for c in "xyz"], 1)
            xi = invert(_corners(batch.column("cnodes"), batch.num_rows), points, geometry, order, steps, levels, eps)
            found = pa.array(~np.isnan(xi).any(1))
            rows = pa.RecordBatch.from_arrays([batch.column("id"), batch.column("elem_id"), pa.FixedSizeListArray.from_arrays(pa.array(xi.ravel()), xi.shape[1]).cast(pa.list_(pa.float64()))], ["id", "elem_id", "xi"])
            yield rows.filter(found)

    return run


def locate(points: DataFrame, elements: DataFrame, nodes: DataFrame | None, elem_type: str, size: float, steps: int = 12, levels: int = 2, eps: float = 1e-9) -> DataFrame:
    """(id, elem_id, xi): the elements (elem_id, node_ids) of a type such as Hex1NL that hold points (id, p), and the coordinates there.

    Elements that have the points of their nodes already, as cnodes, need no nodes. The box of an element's control
    points is dealt to the few cells of its level that it touches, a point to one cell of each level, so large elements
    and small ones may be mixed. Only boxes and points meet by cell; corners go once to the points in their box. An
    element with a missing node holds nothing. A point on the side of several elements is found in each of them."""
    geometry, order, _ = basis.element_type(elem_type)
    whole = elements if "cnodes" in elements.columns else stored(with_corners(elements, nodes).select("elem_id", "cnodes"))
    whole = whole.select("elem_id", "cnodes")
    kinds = {k: t for k, t in points.dtypes + elements.dtypes}
    boxes = stored(whole.mapInArrow(_boxes(geometry, order), f"elem_id {kinds['elem_id']}, " + ", ".join(f"{c} float" for c in BOX)))
    corner = lambda names: F.struct(*(F.col(k).cast("double").alias(c) for k, c in zip(names, "xyz")))
    # Sizes are not estimated from cells and corners, so the joins are told to shuffle: neither side may be small enough to send whole.
    cell = F.xxhash64(*CELL).alias("_cell")
    used = levels_of(boxes.select(box_level(corner(BOX[:3]), corner(BOX[3:]), size).alias("level")))
    placed = with_box_cells(boxes, corner(BOX[:3]), corner(BOX[3:]), size).select(cell, "elem_id", *BOX)
    pairs = with_point_cells(points.select("id", "p"), F.col("p"), size, used or [0]).select(cell, "id", "p").join(placed.hint("merge"), "_cell")
    for c in "xyz":
        pairs = pairs.where(F.col("p")[c].between(F.col(f"_a{c}") - size * eps, F.col(f"_b{c}") + size * eps))
    pairs = pairs.select("id", "p", "elem_id").join(whole.hint("merge"), "elem_id").select("id", "p", "elem_id", "cnodes")
    return pairs.mapInArrow(_inverted(geometry, order, steps, levels, eps), f"id {kinds['id']}, elem_id {kinds['elem_id']}, xi array<double>")
