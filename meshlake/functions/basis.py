"""Basis functions of elements: nodal Lagrange, Bézier, cubic Hermite and Catmull-Rom.

Coefficients are found once on the driver; evaluation is a polynomial in columns.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dimensions of each geometry, and whether it is a simplex.
GEOMETRIES = {"Line": (1, False), "Tri": (2, True), "Quad": (2, False), "Tet": (3, True), "Hex": (3, False)}


def element_type(name: str) -> tuple[str, int, str]:
    """(geometry, order, basis) of names such as Hex3NL."""
    m = re.fullmatch(r"(Line|Tri|Quad|Tet|Hex)(\d+)([A-Z]+)", name)
    if not m:
        raise ValueError(f"no element type is named {name!r}")
    return m[1], int(m[2]), m[3]


def exponents(geometry: str, order: int) -> list[tuple[int, ...]]:
    """Exponents of the monomials, x fastest; for a simplex their sum is bounded by the order."""
    dims, simplex = GEOMETRIES[geometry]
    found = [tuple(reversed(e)) for e in itertools.product(range(order + 1), repeat=dims)]
    return [e for e in found if not simplex or sum(e) <= order]


def node_positions(geometry: str, order: int) -> np.ndarray:
    return np.array(exponents(geometry, order), float) / order


def lagrange_coefficients(geometry: str, order: int) -> np.ndarray:
    """Row i has the monomials' weights in node i's function, which is 1 there and 0 at the other nodes."""
    powers = np.array(exponents(geometry, order))
    vandermonde = np.prod(node_positions(geometry, order)[:, None, :] ** powers[None, :, :], 2)
    return np.linalg.inv(vandermonde).T


def weights_at(geometry: str, order: int, xi: tuple[float, ...]) -> list[float]:
    """The values of all nodal functions at a place known on the driver."""
    monomials = np.prod(np.array(xi) ** np.array(exponents(geometry, order)), 1)
    return (lagrange_coefficients(geometry, order) @ monomials).round(12).tolist()


def lagrange(name: str, xi: list[Column]) -> list[Column]:
    """The values of all nodal functions of an element type."""
    geometry, order, _ = element_type(name)
    powers = exponents(geometry, order)
    monomials = []
    for e in powers:
        term = F.lit(1.0)
        for x, n in zip(xi, e):
            for _ in range(n):
                term = term * x
        monomials.append(term)
    out = []
    for row in lagrange_coefficients(geometry, order):
        total = F.lit(0.0)
        for weight, term in zip(row, monomials):
            if abs(weight) > 1e-12:
                total = total + float(round(weight, 12)) * term
        out.append(total)
    return out


def bezier(t: Column, order: int = 3) -> list[Column]:
    return [math.comb(order, k) * F.pow(t, F.lit(k)) * F.pow(1 - t, F.lit(order - k)) for k in range(order + 1)]


def hermite(t: Column) -> list[Column]:
    """Weights of (first tangent, first point, second point, second tangent)."""
    t2, t3 = t * t, t * t * t
    return [t3 - 2 * t2 + t, 2 * t3 - 3 * t2 + 1, 3 * t2 - 2 * t3, t3 - t2]


def catmull_rom(t: Column) -> list[Column]:
    t2, t3 = t * t, t * t * t
    return [0.5 * (2 * t2 - t - t3), 0.5 * (3 * t3 - 5 * t2 + 2), 0.5 * (4 * t2 + t - 3 * t3), 0.5 * (t3 - t2)]


def combine(weights: list[Column], values: list[Column]) -> Column:
    out = F.lit(0.0)
    for w, v in zip(weights, values):
        out = out + w * v
    return out


def face_nodes(geometry: str, order: int) -> list[list[int]]:
    """Node numbers of every face (edge of a surface): the nodes on one side of the unit element, by their positions."""
    places = node_positions(geometry, order)
    dims, simplex = GEOMETRIES[geometry]
    sides = [places[:, d] for d in range(dims)] + ([1 - places.sum(1)] if simplex else [1 - places[:, d] for d in range(dims)])
    return [np.flatnonzero(np.abs(s) < 1e-9).tolist() for s in sides]


def _jacobi_11(x: Column, n: int) -> Column:
    """The Jacobi polynomial P(1,1) of degree n, by its recurrence."""
    before, own = F.lit(1.0), 2.0 * x
    if n == 0:
        return before
    for k in range(2, n + 1):
        # 2k (k + 2) 2k P_k = (2k + 1) (2k + 2) 2k x P_(k-1) - 2 k k (2k + 2) P_(k-2)
        scale = 4.0 * k * k * (k + 2)
        before, own = own, ((2 * k + 1) * (2 * k + 2) * 2 * k / scale) * x * own - (2.0 * k * k * (2 * k + 2) / scale) * before
    return own


def modal_line(xi: Column, order: int) -> list[Column]:
    """Both ends, then (1 - x)(1 + x) / 4 times the Jacobi polynomials P(1,1), with x = 2 xi - 1."""
    x = 2.0 * xi - 1.0
    return [(1.0 - x) / 2, (1.0 + x) / 2, *((1.0 - x) * (1.0 + x) / 4 * _jacobi_11(x, n) for n in range(order - 1))]


def lobatto_points(order: int) -> np.ndarray:
    """The Gauss-Lobatto points of the unit interval: its ends and the extrema of the Legendre polynomial of this order."""
    legendre = np.polynomial.legendre.Legendre.basis(order)
    return (np.concatenate([[-1.0], np.sort(legendre.deriv().roots().real), [1.0]]) + 1) / 2


def spectral_line(xi: Column, order: int) -> list[Column]:
    """Functions that are 1 at one Gauss-Lobatto point and 0 at the others."""
    points = lobatto_points(order)
    weights = np.linalg.inv(np.vander(points, increasing=True)).T
    return [combine([F.lit(float(w)) for w in row], [F.pow(xi, F.lit(k)) for k in range(order + 1)]) for row in weights]


def tensor(*lines: list[Column]) -> list[Column]:
    """Products of one-dimensional functions, the first one fastest."""
    out = [F.lit(1.0)]
    for line in reversed(lines):
        out = [a * b for a in out for b in line]
    return out


def piecewise_catmull_rom(t: Column, n: int, circular: bool = False) -> list[Column]:
    """Weights of n control points along one axis at t from 0 to 1; ends are doubled, or joined if circular."""
    pieces = n if circular else n - 1
    piece = F.least(F.floor(t * pieces), F.lit(pieces - 1))
    local = catmull_rom(t * pieces - piece)
    # Four control points count at a place; each weight asks for these four only.
    places = [F.pmod(piece + j - 1, F.lit(n)) if circular else F.least(F.greatest(piece + j - 1, F.lit(0)), F.lit(n - 1)) for j in range(4)]
    return [combine([F.when(at == k, 1.0).otherwise(0.0) for at in places], local) for k in range(n)]


def piecewise_catmull_rom_value(values: Column, t: Column, n: int, circular: bool = False) -> Column:
    """The curve through an array of n values at t: the four that count are looked up, however many there are."""
    pieces = n if circular else n - 1
    piece = F.least(F.floor(t * pieces), F.lit(pieces - 1))
    places = [F.pmod(piece + j - 1, F.lit(n)) if circular else F.least(F.greatest(piece + j - 1, F.lit(0)), F.lit(n - 1)) for j in range(4)]
    return combine(catmull_rom(t * pieces - piece), [F.get(values, at.cast("int")) for at in places])


def rational(weights: list[float], shares: list[Column]) -> list[Column]:
    """Functions weighted by control points' weights and divided by their sum: with B-spline functions, a NURBS basis."""
    total = combine([F.lit(float(w)) for w in weights], shares)
    return [float(w) * s / total for w, s in zip(weights, shares)]


def b_spline(t: Column, knots: list[float], degree: int) -> list[Column]:
    """The B-spline functions of a knot vector, by the recurrence of Cox and de Boor; the last knot belongs to the last interval."""
    last = max(k for k in range(len(knots) - 1) if knots[k] < knots[k + 1])
    own = [F.when((t >= a) & ((t <= b) if k == last else (t < b)), 1.0).otherwise(0.0) if a < b else F.lit(0.0) for k, (a, b) in enumerate(zip(knots, knots[1:]))]
    for d in range(1, degree + 1):
        new = []
        for k in range(len(own) - 1):
            left, right = knots[k + d] - knots[k], knots[k + d + 1] - knots[k + 1]
            part = (t - knots[k]) / left * own[k] if left else F.lit(0.0)
            new.append(part + (knots[k + d + 1] - t) / right * own[k + 1] if right else part)
        own = new
    return own


#: Ends of the bands of visible light in nanometres, and red, green and blue at each.
WAVE_STOPS = ((380, (1.0, 0.0, 1.0)), (440, (0.0, 0.0, 1.0)), (490, (0.0, 1.0, 1.0)), (510, (0.0, 1.0, 0.0)), (580, (1.0, 1.0, 0.0)), (645, (1.0, 0.0, 0.0)), (780, (1.0, 0.0, 0.0)))


def wave_color(t: Column) -> Column:
    """Struct (r, g, b) of a wavelength from 0 (violet) to 1 (red) of the visible range, linear between the bands' ends."""
    from .scalars import spectrum

    low, high = WAVE_STOPS[0][0], WAVE_STOPS[-1][0]
    return F.struct(*(spectrum(low + t * (high - low), [(x, c[k]) for x, c in WAVE_STOPS]).alias(n) for k, n in enumerate("rgb")))
