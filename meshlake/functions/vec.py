"""3-vectors, colours, rotations, affine transforms and rays as column expressions.

A vector is a struct (x, y, z); every function takes and gives columns, so Spark
compiles whole formulas into one projection.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: tolerance of comparisons.
EPSILON = 1e-10


def num(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def vec(x, y, z) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))


def from_array(a: Column, at: int = 0) -> Column:
    """Three neighbouring values of an array."""
    return vec(*(F.get(a, at + k).cast("double") for k in range(3)))


def _each(f, *vs) -> Column:
    return vec(*(f(*(v[c] if isinstance(v, Column) else num(v) for v in vs)) for c in "xyz"))


def add(a, b) -> Column:
    return _each(lambda p, q: p + q, a, b)


def sub(a, b) -> Column:
    return _each(lambda p, q: p - q, a, b)


def scale(a, k) -> Column:
    return vec(*(a[c] * num(k) for c in "xyz"))


def dot(a, b) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a, b) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def distance(a, b) -> Column:
    return length(sub(a, b))


def norm(a) -> Column:
    """Unit vector; zero stays zero."""
    n = F.nullif(length(a), F.lit(0.0))
    return vec(*(F.coalesce(a[c] / n, F.when(a[c].isNotNull(), 0.0)) for c in "xyz"))


def absolute(a) -> Column:
    return _each(F.abs, a)


def inverse(a) -> Column:
    """Reciprocals, 0 for 0."""
    return _each(lambda p: F.when(p != 0, 1 / F.when(p != 0, p)).otherwise(0.0), a)


def sign(a) -> Column:
    return _each(lambda p: F.when(p >= 0, 1.0).otherwise(-1.0), a)


def clamp(a, low, high) -> Column:
    return _each(lambda p, q, r: F.greatest(q, F.least(r, p)), a, low, high)


def lerp(a, b, t) -> Column:
    return _each(lambda p, q: p + (q - p) * num(t), a, b)


def angle(a, b) -> Column:
    """0 to pi; 0 where a length vanishes."""
    lengths = length(a) * length(b)
    cos = dot(a, b) / F.when(lengths >= EPSILON, lengths)
    return F.when(lengths < EPSILON, 0.0).when(cos >= 1 - EPSILON, 0.0).when(cos <= -1 + EPSILON, math.pi).otherwise(F.acos(cos))


def polar(a) -> Column:
    """(theta, phi, length)."""
    n = length(a)
    return vec(F.when(n == 0, 0.0).otherwise(F.atan2(a["y"], a["x"])), F.when(n == 0, 0.0).otherwise(F.acos(a["z"] / F.when(n != 0, n))), n)


def from_polar(p) -> Column:
    return vec(p["z"] * F.cos(p["x"]) * F.sin(p["y"]), p["z"] * F.sin(p["x"]) * F.sin(p["y"]), p["z"] * F.cos(p["y"]))


def cylindrical(a) -> Column:
    """(theta, height, radius)."""
    return vec(F.atan2(a["y"], a["x"]), a["z"], F.sqrt(a["x"] * a["x"] + a["y"] * a["y"]))


def from_cylindrical(c) -> Column:
    return vec(c["z"] * F.cos(c["x"]), c["z"] * F.sin(c["x"]), c["y"])


def equal(a, b, eps: float = EPSILON) -> Column:
    return reduce(lambda p, q: p & q, (F.abs(a[c] - b[c]) <= eps for c in "xyz"))


def less(a, b) -> Column:
    """All components less: a partial order."""
    return (a["x"] < b["x"]) & (a["y"] < b["y"]) & (a["z"] < b["z"])


def in_box(p, low, high) -> Column:
    return reduce(lambda a, b: a & b, ((p[c] > low[c] - EPSILON) & (p[c] < high[c] + EPSILON) for c in "xyz"))


def in_sphere(p, center, radius) -> Column:
    d = sub(p, center)
    return dot(d, d) <= num(radius) * num(radius) + EPSILON


def in_oriented_box(p, center, half_x, half_y, half_z) -> Column:
    d = sub(p, center)
    return reduce(lambda a, b: a & b, (F.abs(dot(h, d)) <= dot(h, h) for h in (half_x, half_y, half_z)))


def in_unit_cube(p, margin=0.0) -> Column:
    return reduce(lambda a, b: a & b, (p[c].between(-margin, 1 + margin) for c in "xyz"))


def plane_distance(p, at, normal) -> Column:
    return dot(normal, sub(p, at))


def plane_project(p, at, normal) -> Column:
    return sub(p, scale(normal, plane_distance(p, at, normal)))


def on_plane(p, at, normal) -> Column:
    return F.abs(plane_distance(p, at, normal)) <= EPSILON


def triangle_normal(a, b, c) -> Column:
    return norm(cross(sub(b, a), sub(c, a)))


def triangle_area(a, b, c) -> Column:
    return 0.5 * length(cross(sub(b, a), sub(c, a)))


def tet_volume(a, b, c, d) -> Column:
    return F.abs(dot(sub(a, d), cross(sub(b, d), sub(c, d)))) / 6


def winding(p, a, b, normal) -> Column:
    """-1, 0 or 1 for the turn from a over p to b about a normal."""
    return F.signum(dot(cross(sub(a, p), sub(b, p)), normal))


def parallel(a, b) -> Column:
    return F.abs(F.abs(dot(norm(a), norm(b))) - 1) <= EPSILON


def segment_distance(p, a, b) -> Column:
    """Distance to a segment, -1 beyond its end planes or if it has no length."""
    d, n = sub(b, a), distance(a, b)
    t = dot(sub(p, a), d) / F.when(n >= EPSILON, n * n)
    return F.when((n < EPSILON) | (t < 0) | (t > 1), -1.0).otherwise(distance(p, add(a, scale(d, t))))


def pack_color(r, g, b, a) -> Column:
    """Channels from 0 to 1 as one unsigned 32-bit number, red on top."""
    byte = lambda v: F.floor(num(v) * 255)
    return byte(r) * 16777216 + byte(g) * 65536 + byte(b) * 256 + byte(a)


def unpack_color(v) -> Column:
    part = lambda bits: F.shiftrightunsigned(v, bits).bitwiseAND(F.lit(255)) / 255.0
    return F.struct(part(24).alias("r"), part(16).alias("g"), part(8).alias("b"), part(0).alias("a"))


# Rotations: a struct (x, y, z, w), or its coefficients as plain numbers.


def quaternion(x, y, z, w) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"), num(z).alias("z"), num(w).alias("w"))


def axis_rotation(axis, theta) -> Column:
    n, half = norm(axis), num(theta) / 2
    return quaternion(n["x"] * F.sin(half), n["y"] * F.sin(half), n["z"] * F.sin(half), F.cos(half))


def constant_rotation(axis: tuple, theta: float) -> Column:
    """A rotation known on the driver: four numbers, so that plans stay small."""
    n = math.sqrt(sum(a * a for a in axis))
    k = math.sin(theta / 2) / n if n else 0.0
    return quaternion(*(a * k for a in axis), math.cos(theta / 2))


def rotate(q, v) -> Column:
    """By the matrix of the rotation, so that each component of v stands once in each of the result."""
    rows = []
    for i, j, k in (("x", "y", "z"), ("y", "z", "x"), ("z", "x", "y")):
        own = 1.0 - 2.0 * (q[j] * q[j] + q[k] * q[k])
        rows.append(v[i] * own + v[j] * (2.0 * (q[i] * q[j] - q["w"] * q[k])) + v[k] * (2.0 * (q[i] * q[k] + q["w"] * q[j])))
    return vec(*rows)


def compose(p, q) -> Column:
    """First q, then p."""
    v = add(add(scale(q, p["w"]), scale(p, q["w"])), cross(p, q))
    return quaternion(v["x"], v["y"], v["z"], p["w"] * q["w"] - dot(p, q))


def invert(q) -> Column:
    return quaternion(-q["x"], -q["y"], -q["z"], q["w"])


def rotation_between(a, b) -> Column:
    """The shortest rotation from one direction to another, which must not be opposite."""
    u, v = norm(a), norm(b)
    c, w = cross(u, v), 1 + dot(u, v)
    n = F.sqrt(dot(c, c) + w * w)
    return quaternion(c["x"] / n, c["y"] / n, c["z"] / n, w / n)


def transform(p, translate, scaled, q) -> Column:
    """Scale, then rotate, then translate."""
    return add(rotate(q, _each(lambda a, b: a * b, p, scaled)), translate)


def transform_inverse(p, translate, scaled, q) -> Column:
    return _each(lambda a, b: a * b, rotate(invert(q), sub(p, translate)), inverse(scaled))


def affine_numbers(translate: tuple, scaled: tuple, axis: tuple, theta: float, inverse: bool = False) -> list[list[float]]:
    """Three rows of four numbers: scale, then rotate, then translate, or the way back."""
    import numpy as np

    x, y, z = np.array(axis) / np.linalg.norm(axis)
    c, s = math.cos(theta), math.sin(theta)
    cross_matrix = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    turn = np.eye(3) + s * cross_matrix + (1 - c) * cross_matrix @ cross_matrix
    full = np.eye(4)
    full[:3, :3], full[:3, 3] = turn @ np.diag(scaled), translate
    return (np.linalg.inv(full) if inverse else full)[:3].tolist()


def affine(p, m: list[list[float]]) -> Column:
    """A point by twelve numbers; the plan has each of them once."""
    return vec(*(p["x"] * float(r[0]) + p["y"] * float(r[1]) + p["z"] * float(r[2]) + float(r[3]) for r in m))


def determinant(m: list) -> Column:
    """Of a square matrix of columns, by its first row."""
    if len(m) == 1:
        return m[0][0]
    minor = lambda j: [[v for k, v in enumerate(row) if k != j] for row in m[1:]]
    return reduce(lambda a, b: a + b, (m[0][j] * determinant(minor(j)) * (-1) ** j for j in range(len(m))))


# Rays: an origin and a unit direction.


def ray_plane(origin, direction, at, normal) -> Column:
    """Distance along the ray; null for parallel ones."""
    n = dot(normal, direction)
    return dot(normal, sub(at, origin)) / F.when(F.abs(n) > EPSILON, n)


def ray_sphere(origin, direction, center, radius) -> Column:
    """Array of the two distances; null for a miss."""
    d = sub(center, origin)
    along = dot(d, direction)
    rest = num(radius) * num(radius) - (dot(d, d) - along * along)
    half = F.sqrt(F.when(rest >= 0, rest))
    return F.when(rest >= 0, F.array(along - half, along + half))


def ray_box(origin, direction, low, high) -> Column:
    """Array of entry and exit distance by slabs; null for a miss."""
    inv = inverse(direction)
    near, far = [], []
    for c in "xyz":
        a, b = (low[c] - origin[c]) * inv[c], (high[c] - origin[c]) * inv[c]
        flat = direction[c] == 0
        inside = origin[c].between(low[c], high[c])
        near.append(F.when(flat, F.when(inside, -1e300).otherwise(1e300)).otherwise(F.least(a, b)))
        far.append(F.when(flat, F.when(inside, 1e300).otherwise(-1e300)).otherwise(F.greatest(a, b)))
    t0, t1 = F.greatest(*near), F.least(*far)
    return F.when((t1 >= t0) & (t1 >= 0), F.array(t0, t1))


def ray_triangle(origin, direction, a, b, c) -> Column:
    """Struct (t, u, v) in barycentric coordinates; null for a miss."""
    e, f = sub(b, a), sub(c, a)
    h = cross(direction, f)
    d = dot(e, h)
    inv = 1 / F.when(F.abs(d) > EPSILON, d)
    s = sub(origin, a)
    u = dot(s, h) * inv
    q = cross(s, e)
    v, t = dot(direction, q) * inv, dot(f, q) * inv
    return F.when((u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), F.struct(t.alias("t"), u.alias("u"), v.alias("v")))


def ray_at(origin, direction, t) -> Column:
    return add(origin, scale(direction, t))


def ray_project(origin, direction, p) -> Column:
    """How far along the ray the foot of p lies."""
    return dot(sub(p, origin), direction)


# Boxes: a low and a high corner.


def box_contains(low, high, other_low, other_high) -> Column:
    return in_box(other_low, low, high) & in_box(other_high, low, high)


def box_corners(low, high) -> list[Column]:
    return [vec(*((high if k >> j & 1 else low)[c] for j, c in enumerate("xyz"))) for k in range(8)]


def box_has_corner(low, high, other_low, other_high) -> Column:
    """Whether a corner of the other box lies in this one. Boxes that only cross have none in each other."""
    return reduce(lambda a, b: a | b, (in_box(p, low, high) for p in box_corners(other_low, other_high)))


def box_overlaps(low, high, other_low, other_high) -> Column:
    return reduce(lambda a, b: a & b, ((low[c] <= other_high[c]) & (other_low[c] <= high[c]) for c in "xyz"))


def box_intersection(low, high, other_low, other_high) -> tuple[Column, Column]:
    """The other box with its corners clamped to this one."""
    return clamp(other_low, low, high), clamp(other_high, low, high)


def box_cut_by_plane(low, high, at, normal) -> Column:
    """Whether a plane has corners of the box on both sides or on it."""
    reach = reduce(lambda a, b: a + b, (F.abs(normal[c]) * (high[c] - low[c]) for c in "xyz"))
    return F.abs(plane_distance(add(low, high), scale(at, 2.0), normal)) <= reach


def symmetric_minors(m: list) -> list[Column]:
    """The principal minors of a 3 × 3 matrix of columns."""
    pick = lambda ks: [[m[i][j] for j in ks] for i in ks]
    return [determinant(pick(ks)) for ks in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))]


def is_positive(m: list, eps: float = 0.0) -> Column:
    """Whether a symmetric 3 × 3 matrix has no negative eigenvalue: all principal minors are at least -eps."""
    return reduce(lambda a, b: a & b, (x >= -eps for x in symmetric_minors(m)))


# Image planes: a corner, a rotation, and width and height along x and the falling y axis.


def plane_xi(p, at, q, width, height) -> Column:
    """World to plane: x and y from 0 to 1 over width and height, z the distance from the plane."""
    local = rotate(invert(q), sub(p, at))
    return vec(local["x"] / num(width), -local["y"] / num(height), local["z"])


def plane_position(xi, at, q, width, height) -> Column:
    """Plane to world."""
    return add(rotate(q, vec(xi["x"] * num(width), -xi["y"] * num(height), xi["z"])), at)


def pixel_position(row, col, at, q, size_x, size_y) -> Column:
    """The world position of a pixel's centre."""
    return add(rotate(q, vec((num(col) + 0.5) * num(size_x), -(num(row) + 0.5) * num(size_y), 0.0)), at)
