"""Spatial keys, selection by planes and boxes, adjacency, and deduplication of nodes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis, vec
from .grid import box_of, levels_of, meeting, numbers, with_box_cells, with_point_cells
from .stored import stored


def cell(p: Column, low: tuple, high: tuple, depth: int) -> list[Column]:
    """The grid cell of a point along x, y and z among 2**depth, clamped to the box."""
    n = 1 << depth
    return [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((p[c] - a) / (b - a) * n))).cast("bigint") for c, a, b in zip("xyz", low, high)]


def leaf_key(p: Column, low: tuple, high: tuple, depth: int) -> Column:
    """Octree leaf: interleaved bits of the cell, x lowest."""
    bits = [F.shiftleft(F.shiftright(v, d).bitwiseAND(F.lit(1)), 3 * d + k) for d in range(depth) for k, v in enumerate(cell(p, low, high, depth))]
    return reduce(lambda a, b: a + b, bits)


def leaves(elements: DataFrame, nodes: DataFrame, low: tuple, high: tuple, depth: int) -> DataFrame:
    """(elem_id, leaf) for every leaf that holds a node of the element. nodes: (node_id, p)."""
    wide = elements.select("elem_id", F.explode("node_ids").alias("node_id"))
    return wide.join(nodes.select("node_id", leaf_key(F.col("p"), low, high, depth).alias("leaf")), "node_id").select("elem_id", "leaf").distinct()


def cut_by_plane(df: DataFrame, points: str, at, normal) -> DataFrame:
    """Rows whose array of points has some on either side of a plane or on it."""
    d = F.transform(points, lambda p: vec.plane_distance(p, at, normal))
    return df.withColumn("_d", d).where((F.array_min("_d") <= 0) & (F.array_max("_d") >= 0)).drop("_d")


def adjacency(faces: DataFrame) -> DataFrame:
    """(elem_id, face, other_elem, other_face) of faces with the same nodes in different elements. faces: (elem_id, face, node_ids).

    Pairs within a set of nodes: in a mesh at most two elements share a face."""
    keyed = faces.select("elem_id", "face", F.array_sort("node_ids").alias("key"))
    other = keyed.select(F.col("elem_id").alias("other_elem"), F.col("face").alias("other_face"), "key")
    return keyed.join(other, "key").where("elem_id <> other_elem").drop("key")


def external(faces: DataFrame) -> DataFrame:
    """Faces that one element has alone: one aggregation instead of a self-join."""
    keyed = faces.withColumn("key", F.array_sort("node_ids"))
    alone = keyed.groupBy("key").agg(F.min("elem_id").alias("elem_id"), F.max("elem_id").alias("_last"), F.min("face").alias("face"))
    return alone.where("elem_id = _last").select("elem_id", "face")


def dedup_nodes(nodes: DataFrame, digits: int = 9) -> DataFrame:
    """(node_id, keep_id): nodes with equal rounded coordinates share the least id.

    Equality by rounding is transitive, unlike a distance: nodes nearer than the rounding step stay apart if an edge of rounding lies between them."""
    keyed = nodes.select("node_id", F.struct(*(F.round(F.col("p")[c], digits).alias(c) for c in "xyz")).alias("_key"))
    least = keyed.groupBy("_key").agg(F.min("node_id").alias("keep_id"))
    return keyed.join(least.withColumnRenamed("_key", "_k"), F.col("_key").eqNullSafe(F.col("_k"))).select("node_id", "keep_id")


def reindex(index: DataFrame, key: str = "elem_id", ids: str = "node_ids") -> DataFrame:
    """(node_id, new_id): used nodes numbered in the order of their first use, nodes with the same one by their number. Only one row per node reaches the ordering."""
    used = index.select(F.col(key).alias("_e"), F.posexplode(ids).alias("_k", "node_id")).groupBy("node_id").agg(F.min(F.struct("_e", "_k")).alias("_use"))
    from .matrix import dense_ids

    return dense_ids(used, ["_use", "node_id"], "new_id").select("node_id", "new_id")


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """(node_id, normal): normalised sums of the normals of incident triangles. triangles: (node_ids, a, b, c)."""
    n = vec.triangle_normal(F.col("a"), F.col("b"), F.col("c"))
    wide = triangles.select("node_ids", n.alias("n")).select(F.explode("node_ids").alias("node_id"), "n")
    sums = wide.groupBy("node_id").agg(*(F.sum(F.col("n")[c]).alias(c) for c in "xyz"))
    return sums.select("node_id", F.struct("x", "y", "z").alias("n")).select("node_id", vec.norm(F.col("n")).alias("normal"))


#: Points of one y that are looked at together, as bits of a positive number, and neighbours among which they are sought.
RUN, NEIGHBOURS = 62, 2000


def _banded(edges: DataFrame, band: float) -> tuple[DataFrame, Column, Column, Callable[[str], Column]]:
    """Edges once for each band of y that they pass, whether an edge crosses y, the x where it does, and the band of a y."""
    at = lambda c: F.floor(F.col(c) / band) if isinstance(c, str) else F.floor(c / band)
    banded = edges.select("*", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))).alias("_band"))
    crosses = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    x = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    return banded, crosses, x, at


def points_in_polygon(points: DataFrame, edges: DataFrame, band: float = 0.05) -> DataFrame:
    """(poly, id): points (id, x, y) inside polygons of edges (poly, x1, y1, x2, y2), by odd crossings.

    Points meet only the edges of their band of y, of height `band`; an edge is in all bands that it passes."""
    banded, crosses, x, at = _banded(edges, band)
    hits = points.withColumn("_band", at("y")).join(banded, "_band").where(crosses & (F.col("x") < x))
    return hits.groupBy("poly", "id").agg(F.count("*").alias("_n")).where("_n % 2 = 1").select("poly", "id")


def pixels_in_polygon(pixels: DataFrame, edges: DataFrame, band: float = 0.05) -> DataFrame:
    """The same for points that share few values of y, as pixels do.

    Neighbours of one y meet an edge together, as a run by x: what lies left of the crossing is a number whose low bits are
    set, and the bits that an odd number of a polygon's edges set are points inside. So a polygon has a row for each run
    that it meets, not for each pixel."""
    banded, crosses, x, at = _banded(edges, band)
    blocks = pixels.select("id", F.col("x").cast("double"), F.col("y").cast("double")).dropna(subset=["x", "y"]).withColumn("_block", F.floor(F.monotonically_increasing_id() / NEIGHBOURS))
    rows = blocks.groupBy("y", "_block").agg(F.array_sort(F.collect_list(F.struct("x", "id"))).alias("_p"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("_p") - 1) / RUN).cast("int")), lambda k: F.slice("_p", k * RUN + 1, F.lit(RUN)))
    runs = stored(rows.select("y", F.explode(cut).alias("_p")).select("y", F.col("_p.x").alias("xs"), F.col("_p.id").alias("ids"), F.monotonically_increasing_id().alias("_run")))
    met = runs.select("_run", "y", "xs", at("y").alias("_band")).join(banded, "_band").where(crosses).select("poly", "_run", "xs", x.alias("_x"), F.lit(0).alias("_left"))
    # How many points lie left, by halves.
    half = 1 << RUN.bit_length() - 1
    while half:
        met = met.withColumn("_left", F.col("_left") + F.when(F.get("xs", F.col("_left") + (half - 1)) < F.col("_x"), half).otherwise(0))
        half //= 2
    bits = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_left")) - 1
    odd = met.select("poly", "_run", bits.alias("_bits")).groupBy("poly", "_run").agg(F.bit_xor("_bits").alias("_bits")).where("_bits <> 0")
    inside = odd.join(runs.select("_run", "ids"), "_run").select("poly", "_bits", F.posexplode("ids").alias("_k", "id"))
    return inside.where("shiftright(_bits, _k) & 1 = 1").select("poly", "id")


def ray_hits(triangles: DataFrame, origin: Column, direction: Column) -> DataFrame:
    """triangles (tri_id, a, b, c) that a ray hits, with hit (t, u, v)."""
    return triangles.withColumn("hit", vec.ray_triangle(origin, direction, F.col("a"), F.col("b"), F.col("c"))).where("hit is not null")


def first_hits(hits: DataFrame, n: int, nearest: bool = False) -> DataFrame:
    """The first n hits by the number of the triangle, or the nearest ones."""
    return hits.orderBy(*([F.col("hit.t")] if nearest else []), "tri_id").limit(n)


def leaf_box(leaf: Column, low: tuple, high: tuple, depth: int) -> tuple[Column, Column]:
    """The corners of an octree leaf from its key."""
    corners = []
    for k, (a, b) in enumerate(zip(low, high)):
        at = reduce(lambda x, y: x + y, (F.shiftleft(F.shiftrightunsigned(leaf, 3 * d + k).bitwiseAND(F.lit(1)), d) for d in range(depth)))
        corners.append((a + at * ((b - a) / (1 << depth)), a + (at + 1) * ((b - a) / (1 << depth))))
    return vec.vec(*(c[0] for c in corners)), vec.vec(*(c[1] for c in corners))


def leaves_cut_by_plane(leaves: DataFrame, at: Column, normal: Column, low: tuple, high: tuple, depth: int) -> DataFrame:
    """The rows of leaves (leaf, ...) whose box a plane cuts: what a query about the plane has to read."""
    return leaves.where(F.exists(F.array("leaf"), lambda leaf: vec.box_cut_by_plane(*leaf_box(leaf, low, high, depth), at, normal)))


def merge_leaves(a: DataFrame, b: DataFrame, merge: dict[str, Column]) -> DataFrame:
    """Two tables by leaf as one: a union and one aggregation."""
    return a.unionByName(b).groupBy("leaf").agg(*(c.alias(k) for k, c in merge.items()))


def with_corners(elements: DataFrame, nodes: DataFrame) -> DataFrame:
    """elements (elem_id, node_ids) with cnodes, the points of their nodes in order. nodes: (node_id, p)."""
    wide = elements.select("elem_id", F.posexplode("node_ids").alias("_k", "node_id")).join(nodes.select("node_id", "p"), "node_id", "left")
    corners = wide.groupBy("elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "p"))), lambda c: c["p"]).alias("cnodes"))
    return elements.join(corners, "elem_id")


def select_elements(elements: DataFrame, nodes: DataFrame, predicate: str) -> DataFrame:
    """Elements that a SQL predicate over elem_id, node_ids, cnodes and their other columns keeps."""
    return with_corners(elements, nodes).where(F.expr(predicate))


def tet_xi(p: Column, a: Column, b: Column, c: Column, d: Column) -> Column:
    """Coordinates of a point along the three edges from a; null in a flat tetrahedron."""
    u, v, w, r = vec.sub(b, a), vec.sub(c, a), vec.sub(d, a), vec.sub(p, a)
    whole = vec.dot(u, vec.cross(v, w))
    det = F.when(F.abs(whole) > 1e-300, whole)
    return vec.vec(vec.dot(r, vec.cross(v, w)) / det, vec.dot(u, vec.cross(r, w)) / det, vec.dot(u, vec.cross(v, r)) / det)


def _tets_with(eps: float):
    cross = lambda a, b: np.stack([a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]])
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]

    def run(points: pa.Table, tets: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        p = numbers(points, ["p"])
        corner = [numbers(tets, [c]) for c in "abcd"]
        a, (u, v, w) = corner[0], (c - corner[0] for c in corner[1:])
        vw = cross(v, w)
        det = dot(u, vw)
        det = np.where(np.abs(det) > 1e-300, det, np.nan)
        none = np.zeros(0, int)
        found = [(none, none, np.zeros((3, 0)))]
        for i, j in pairs:
            r = p[:, i] - a[:, j]
            xi = [dot(r, vw[:, j]) / det[j]]
            # Half of the pairs end with each coordinate.
            for k in (1, 2):
                near = (xi[0] >= -eps) & (xi[-1] >= -eps) & (sum(xi) <= 1 + 4 * eps)
                i, j, r, xi = i[near], j[near], r[:, near], [x[near] for x in xi]
                xi.append(dot(u[:, j], cross(r, w[:, j]) if k == 1 else cross(v[:, j], r)) / det[j])
            inside = (np.minimum(np.minimum(xi[0], xi[1]), xi[2]) >= -eps) & (xi[0] + xi[1] + xi[2] <= 1 + eps)
            found.append((i[inside], j[inside], np.stack(xi)[:, inside]))
        i, j, xi = (np.concatenate(x, axis=-1) for x in zip(*found))
        at = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in xi], list("xyz"))
        return pa.table([points.column("id").take(pa.array(i)), tets.column("elem_id").take(pa.array(j)), at], ["id", "elem_id", "xi"])

    return run


def locate(points: DataFrame, tets: DataFrame, size: float, eps: float = 1e-9) -> DataFrame:
    """(id, elem_id, xi): the tetrahedra that hold points (id, p). tets: (elem_id, a, b, c, d).

    Tetrahedra are dealt to the few cells of their level that their boxes touch, points to one cell of each level; numpy
    works on the pairs of a cell, however many tetrahedra lie in it. Cells of level 0 should be about as large as small
    elements."""
    low, high = box_of([F.col(c) for c in "abcd"])
    boxed = stored(tets.select("elem_id", *"abcd", low.alias("_low_at"), high.alias("_high_at")))
    placed = stored(with_box_cells(boxed, F.col("_low_at"), F.col("_high_at"), size).drop("_low_at", "_high_at"))
    asked = with_point_cells(points.select("id", "p"), F.col("p"), size, levels_of(placed) or [0])
    kinds = {k: t for k, t in points.dtypes + tets.dtypes}
    return meeting(asked, placed, _tets_with(eps), f"id {kinds['id']}, elem_id {kinds['elem_id']}, xi struct<x:double,y:double,z:double>")


def thin_points(points: DataFrame, distance: float, priority: str) -> DataFrame:
    """Points (id, x, y, ...) without another one of less priority (then less id) within a distance: blue noise from random points.

    A point meets those of its own and the eight cells around it."""
    at = lambda c: F.floor(F.col(c) / distance)
    around = F.sequence(F.lit(-1), F.lit(1))
    sent = points.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(priority).alias("_p"), F.col("id").alias("_id"), at("x").alias("_a"), at("y").alias("_b"))
    sent = sent.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around)).select("_x", "_y", "_p", "_id", (F.col("_a") + F.col("_i")).alias("_a"), (F.col("_b") + F.col("_j")).alias("_b"))
    near = (F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2) < distance * distance) & ((F.col("_p") < F.col(priority)) | ((F.col("_p") == F.col(priority)) & (F.col("_id") < F.col("id"))))
    placed = points.withColumns({"_a": at("x"), "_b": at("y")})
    return placed.join(sent, (placed["_a"] == sent["_a"]) & (placed["_b"] == sent["_b"]) & near, "left_anti").drop("_a", "_b")


def maximal_points(points: DataFrame, distance: float, priority: str, coordinates: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """The points (id, coordinates, priority) that a greedy choice by priority, then id, takes when no two may be nearer than a distance: a maximal Poisson-disc sample.

    A round takes every point that is first among those within the distance that are left, and drops their neighbours; it
    ends when none is left, after about log n rounds for random priorities. Cells are so small that only one point of a
    cell can be taken, its first. So a point meets one point of each of the cells around it, however dense they are."""
    side, reach = distance / math.sqrt(len(coordinates)), math.ceil(math.sqrt(len(coordinates)))
    cells = [f"_c{k}" for k in range(len(coordinates))]
    order = F.struct(F.col(priority).alias("p"), F.col("id").alias("id"))
    left = stored(points.select("id", *coordinates, priority, order.alias("_o"), *(F.floor(F.col(c) / side).alias(k) for c, k in zip(coordinates, cells))))
    chosen = left.limit(0)

    def around(df: DataFrame) -> DataFrame:
        for k in cells:
            df = df.withColumn("_s", F.explode(F.sequence(F.col(k) - reach, F.col(k) + reach))).drop(k).withColumnRenamed("_s", k)
        return df

    near = reduce(lambda a, b: a + b, (F.pow(F.col(c) - F.col(f"_f{k}"), 2) for k, c in enumerate(coordinates))) < distance * distance
    while not left.isEmpty():
        first = left.groupBy(*cells).agg(F.min_by(F.struct("id", *coordinates, priority, "_o"), "_o").alias("_w")).select(*cells, "_w.*")
        first = stored(first)
        rivals = around(left.select(*coordinates, F.col("_o").alias("_r"), *cells)).join(first.select(*cells, F.col("_o"), *(F.col(c).alias(f"_f{k}") for k, c in enumerate(coordinates))), cells)
        blocked = rivals.where((F.col("_r") < F.col("_o")) & near).select(*cells).distinct()
        taken = stored(first.join(blocked, cells, "left_anti").select(*left.columns))
        chosen = chosen.unionByName(taken)
        gone = left.join(around(taken.select(*cells, *(F.col(c).alias(f"_f{k}") for k, c in enumerate(coordinates)))), cells).where(near).select("id")
        left = stored(left.join(gone, "id", "left_anti"))
    return points.join(chosen.select("id"), "id", "left_semi")


def nearest_plane(points: DataFrame, planes: DataFrame, key: str) -> DataFrame:
    """points (key, id, p) with the nearest plane (key, plane_id, at, normal) of their key and the point projected on it; ties go to the least plane.

    The planes of a key, the slices of one stack, are held as one array."""
    stacks = planes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("plane_id", "at", "normal"))).alias("_planes"))
    distance = lambda s: F.abs(vec.plane_distance(F.col("p"), s["at"], s["normal"]))
    best = F.array_min(F.transform("_planes", lambda s: F.struct(distance(s).alias("d"), s["plane_id"].alias("plane_id"), s["at"].alias("at"), s["normal"].alias("normal"))))
    found = points.join(stacks, key).withColumn("_best", best)
    return found.withColumns({"plane_id": F.col("_best.plane_id"), "plane_distance": F.col("_best.d"), "projected": vec.plane_project(F.col("p"), F.col("_best.at"), F.col("_best.normal"))}).drop("_planes", "_best")


def free_form(p: Column, low: tuple, high: tuple, lattice: list[list[list[tuple]]]) -> Column:
    """A point moved by a lattice of control points over a box, weighted by Bernstein polynomials; points outside stay.

    lattice[k][j][i] is the control point i along x, j along y and k along z."""
    xi = [(p[c] - a) / (b - a) for c, a, b in zip("xyz", low, high)]
    wx, wy, wz = (basis.bezier(t, n - 1) for t, n in zip(xi, (len(lattice[0][0]), len(lattice[0]), len(lattice))))
    moved = []
    for axis in range(3):
        moved.append(reduce(lambda a, b: a + b, (wz[k] * wy[j] * wx[i] * float(lattice[k][j][i][axis]) for k in range(len(wz)) for j in range(len(wy)) for i in range(len(wx)) if abs(lattice[k][j][i][axis]) >= 1e-8)) if any(abs(q[axis]) >= 1e-8 for s in lattice for r in s for q in r) else F.lit(0.0))
    inside = reduce(lambda a, b: a & b, (t.between(0, 1) for t in xi))
    return F.when(inside, vec.vec(*moved)).otherwise(p)


def glyphs(nodes: DataFrame, values: Column, scale: Column) -> DataFrame:
    """nodes (node_id, p) with direction and scale of a glyph at each."""
    return nodes.withColumns({"direction": vec.norm(values), "scale": scale})


def directional_fields(nodes: DataFrame, base: Column, apex: Column) -> DataFrame:
    """nodes with unit vectors along the axis from base to apex, away from it, and around it."""
    axis = vec.norm(vec.sub(apex, base))
    out = nodes.withColumn("longitudinal", axis)
    out = out.withColumn("_away", vec.sub(vec.plane_project(F.col("p"), base, F.col("longitudinal")), base))
    out = out.withColumn("radial", vec.norm(F.col("_away"))).drop("_away")
    return out.withColumn("circumferential", vec.cross(F.col("longitudinal"), F.col("radial")))


def twist(p0: Column, p1: Column, base: Column, axis: Column) -> Column:
    """Degrees that a point has turned about an axis through base, positive by the right hand."""
    both = F.array(F.struct(*(vec.sub(vec.plane_project(p, base, axis), base).alias(k) for k, p in (("a", p0), ("b", p1)))))
    angle = lambda s: F.degrees(F.atan2(vec.dot(axis, vec.cross(s["a"], s["b"])), vec.dot(s["a"], s["b"])))
    return F.get(F.transform(both, angle), 0)
