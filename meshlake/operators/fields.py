"""Derivatives of fields: over grids by neighbours, over elements by shape functions; strain from displacements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis, vec
from .spatial import with_corners


def grid_gradient(df: DataFrame, keys: list[str], axes: tuple[str, str, str], values: list[str], spacing: tuple[float, float, float]) -> DataFrame:
    """df with d_<value>_<axis> for each value and axis: central differences of the two neighbours along an axis, one-sided at
    the edge, null without any neighbour. Each point sends its values to its six neighbours, and one aggregation collects them."""
    offsets = [(a, s) for a in range(3) for s in (-1, 1)]
    stencil = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(s).alias("s")) for a, s in [(-1, 0), *offsets]))
    sent = df.select(*keys, *axes, *values, F.explode(stencil).alias("_o"))
    target = [(F.col(c) + F.when(F.col("_o.a") == k, F.col("_o.s")).otherwise(0)).alias(c) for k, c in enumerate(axes)]
    part = lambda a, s, v: F.max(F.when((F.col("_o.a") == a) & (F.col("_o.s") == s), F.col(v)))
    # A point that receives something from side -1 of an axis lies one step before the sender.
    names = {f"_{v}_{a}_{s}": (a, s, v) for v in values for a, s in offsets}
    own = {f"_own_{v}": F.max(F.when(F.col("_o.a") == -1, F.col(v))) for v in values}
    moved = sent.select(*keys, *target, *values, "_o")
    found = moved.groupBy(*keys, *axes).agg(F.max(F.col("_o.a") == -1).alias("_real"), *(c.alias(k) for k, c in own.items()), *(part(a, s, v).alias(k) for k, (a, s, v) in names.items()))
    slopes = []
    for v in values:
        for a, c in enumerate(axes):
            after, before, at, h = F.col(f"_{v}_{a}_-1"), F.col(f"_{v}_{a}_1"), F.col(f"_own_{v}"), float(spacing[a])
            slopes.append(F.when(after.isNotNull() & before.isNotNull(), (after - before) / (2 * h)).when(after.isNotNull(), (after - at) / h).when(before.isNotNull(), (at - before) / h).alias(f"d_{v}_{c}"))
    return df.join(found.where("_real").select(*keys, *axes, *slopes), [*keys, *axes])


def lagrange_strain(gradient: list[list[Column]]) -> list[list[Column]]:
    """Green-Lagrange strain ½ (FᵀF - I) with F = I + gradient, gradient[i][j] being the derivative of component i along axis j."""
    f = [[g + 1.0 if i == j else g for j, g in enumerate(row)] for i, row in enumerate(gradient)]
    return [[0.5 * (reduce(lambda a, b: a + b, (f[k][i] * f[k][j] for k in range(3))) - (1.0 if i == j else 0.0)) for j in range(3)] for i in range(3)]


def grid_strain(df: DataFrame, keys: list[str], axes: tuple[str, str, str], values: tuple[str, str, str], spacing: tuple[float, float, float]) -> DataFrame:
    """df with e_<axis><axis> of the strain of a sampled displacement field (values in the order of the axes)."""
    sloped = grid_gradient(df, keys, axes, list(values), spacing)
    e = lagrange_strain([[F.col(f"d_{v}_{a}") for a in axes] for v in values])
    out = sloped.withColumns({f"e_{axes[i]}{axes[j]}": e[i][j] for i in range(3) for j in range(i, 3)})
    return out.drop(*(f"d_{v}_{a}" for v in values for a in axes))


def _slopes(name: str, xi: tuple[float, ...]) -> list[list[float]]:
    """The derivatives of nodal functions along each coordinate at a place: numbers, found on the driver."""
    import numpy as np

    geometry, order, _ = basis.element_type(name)
    powers = np.array(basis.exponents(geometry, order))
    out = []
    for d in range(powers.shape[1]):
        e = powers.copy()
        e[:, d] = np.maximum(e[:, d] - 1, 0)
        out.append((basis.lagrange_coefficients(geometry, order) @ (powers[:, d] * np.prod(np.array(xi) ** e, 1))).round(12).tolist())
    return out


def _jacobian(nodes: str, slopes: list[list[float]], field: str | None = None) -> list[list[Column]]:
    """[component][coordinate]: the sum of nodes times derivatives."""
    rows = [F.lit(s) for s in slopes]
    value = (lambda p, c: p[field][c]) if field else (lambda p, c: p[c])
    return [[F.aggregate(F.zip_with(nodes, r, lambda p, w: value(p, c) * w), F.lit(0.0), lambda s, v: s + v) for r in rows] for c in "xyz"]  # noqa: B023


def element_strain(elements: DataFrame, nodes: DataFrame, elem_type: str, xi: tuple[float, float, float]) -> DataFrame:
    """(elem_id, volume, e_xx … e_zz): strain at one place of every volume element, from nodes (node_id, p, u) with displacements u.

    The gradient is that of u by the element's coordinates times the inverse of the Jacobian of p; volume is its
    determinant. Null in flat elements and where a node is missing."""
    named = nodes.select("node_id", F.struct("p", "u").alias("p"))
    corners = with_corners(elements, named)
    slopes = _slopes(elem_type, xi)
    j, g = _jacobian("cnodes", slopes, "p"), _jacobian("cnodes", slopes, "u")
    flat = corners.select("elem_id", *(j[i][k].alias(f"_j{i}{k}") for i in range(3) for k in range(3)), *(g[i][k].alias(f"_g{i}{k}") for i in range(3) for k in range(3)))
    m = [[F.col(f"_j{i}{k}") for k in range(3)] for i in range(3)]
    flat = flat.withColumn("volume", vec.determinant(m))
    # The inverse by cofactors; cyclic indexes carry the signs.
    cofactor = lambda i, k: m[(i + 1) % 3][(k + 1) % 3] * m[(i + 2) % 3][(k + 2) % 3] - m[(i + 1) % 3][(k + 2) % 3] * m[(i + 2) % 3][(k + 1) % 3]
    inverse = [[cofactor(k, i) / F.when(F.abs("volume") > 1e-300, F.col("volume")) for k in range(3)] for i in range(3)]
    flat = flat.select("*", *(inverse[i][k].alias(f"_i{i}{k}") for i in range(3) for k in range(3)))
    gradient = [[reduce(lambda a, b: a + b, (F.col(f"_g{i}{k}") * F.col(f"_i{k}{c}") for k in range(3))) for c in range(3)] for i in range(3)]
    flat = flat.select("elem_id", "volume", *(gradient[i][c].alias(f"_d{i}{c}") for i in range(3) for c in range(3)))
    e = lagrange_strain([[F.col(f"_d{i}{c}") for c in range(3)] for i in range(3)])
    return flat.select("elem_id", "volume", *(e[i][k].alias(f"e_{'xyz'[i]}{'xyz'[k]}") for i in range(3) for k in range(i, 3)))
