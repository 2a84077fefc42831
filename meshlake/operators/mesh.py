"""Meshes: edges, field evaluation, iso crossings, triangulation, refinement templates and generated grids."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import basis
from ..functions.vec import vec

#: Corner pairs that are edges, and corner lists of faces, of linear elements with x fastest.
EDGES = {
    "Line": [(0, 1)],
    "Tri": [(0, 1), (1, 2), (2, 0)],
    "Quad": [(0, 1), (1, 3), (3, 2), (2, 0)],
    "Tet": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    "Hex": [(0, 1), (1, 3), (3, 2), (2, 0), (4, 5), (5, 7), (7, 6), (6, 4), (0, 4), (1, 5), (2, 6), (3, 7)],
}
FACES = {
    "Tri": [(0, 1, 2)],
    "Quad": [(0, 1, 2, 3)],
    "Tet": [(0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3)],
    "Hex": [(0, 1, 2, 3), (4, 5, 6, 7), (0, 1, 4, 5), (2, 3, 6, 7), (0, 2, 4, 6), (1, 3, 5, 7)],
}


def _pick(ids: str, corners: tuple[int, ...]) -> Column:
    return F.array(*(F.get(ids, k) for k in corners))


def faces(elements: DataFrame, geometry: str) -> DataFrame:
    """(elem_id, face, node_ids) of every face."""
    template = F.array(*(F.struct(F.lit(k).alias("face"), _pick("node_ids", c).alias("ids")) for k, c in enumerate(FACES[geometry])))
    return elements.select("elem_id", F.explode(template).alias("f")).select("elem_id", "f.face", F.col("f.ids").alias("node_ids"))


def edges(elements: DataFrame, geometry: str = "Tri") -> DataFrame:
    """(elem_id, edge, a, b) of every edge."""
    template = F.array(*(F.struct(F.lit(k).alias("edge"), F.get("node_ids", a).alias("a"), F.get("node_ids", b).alias("b")) for k, (a, b) in enumerate(EDGES[geometry])))
    return elements.select("elem_id", F.explode(template).alias("e")).select("elem_id", "e.*")


def unique_edges(elements: DataFrame, geometry: str = "Tri") -> DataFrame:
    return edges(elements, geometry).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def iso_crossings(elements: DataFrame, values: DataFrame, iso: float, geometry: str = "Tri") -> DataFrame:
    """(elem_id, edge, a, b, t): where a value lies on an edge, t from a to b. values: (node_id, val)."""
    va = values.select(F.col("node_id").alias("a"), F.col("val").alias("va"))
    vb = values.select(F.col("node_id").alias("b"), F.col("val").alias("vb"))
    wide = edges(elements, geometry).join(va, "a").join(vb, "b")
    crossing = wide.where((F.least("va", "vb") <= iso) & (F.greatest("va", "vb") >= iso) & (F.col("va") != F.col("vb")))
    return crossing.select("elem_id", "edge", "a", "b", ((iso - F.col("va")) / (F.col("vb") - F.col("va"))).alias("t"))


def iso_values(low: float, high: float, k: int) -> list[float]:
    """k evenly spaced values with both ends, the middle for one."""
    return [(low + high) / 2] if k == 1 else [low + (high - low) * i / (k - 1) for i in range(k)]


def _whole(x: Column) -> Column:
    """The sum, or null if a part is null."""
    return F.when(F.count(x) == F.count("*"), F.sum(x))


def evaluate(elements: DataFrame, values: DataFrame, elem_type: str, xi: tuple[float, ...]) -> DataFrame:
    """(elem_id, val): the field at one place of every element, null where a node has no value. Values are weighted as they are joined, so sums combine before the shuffle."""
    weights = F.array(*basis.lagrange(elem_type, [F.lit(float(x)) for x in xi]))
    wide = elements.select("elem_id", F.posexplode("node_ids").alias("k", "node_id"))
    joined = wide.join(values, "node_id", "left").withColumn("w", F.get(weights, F.col("k")))
    return joined.groupBy("elem_id").agg(_whole(F.col("w") * F.col("val")).alias("val"))


def positions(elements: DataFrame, nodes: DataFrame, elem_type: str, xi: list[tuple[float, ...]]) -> DataFrame:
    """(elem_id, k, p): points at places of every element; coordinates are null where a node is missing. nodes: (node_id, p).

    An element's nodes come into one row first, and its places are made from that row, so tasks hold a row for each
    element, not for each place. Nodes are dealt by element before they are gathered, as few would meet before."""
    geometry, order, _ = basis.element_type(elem_type)
    n = len(basis.node_positions(geometry, order))
    weights = F.from_json(F.lit(json.dumps([basis.weights_at(geometry, order, place) for place in xi])), "array<array<double>>")
    wide = elements.select("elem_id", F.posexplode("node_ids").alias("_k", "node_id")).join(nodes, "node_id", "left")
    dealt = wide.select("elem_id", "_k", *(F.col(f"p.{c}").alias(c) for c in "xyz")).repartition("elem_id")
    corners = dealt.groupBy("elem_id").agg(F.count("*").alias("_n"), *(F.max(F.when(F.col("_k") == k, F.col(c))).alias(f"_{c}{k}") for c in "xyz" for k in range(n)))
    placed = corners.select("*", F.posexplode(weights).alias("k", "_w"))
    at = lambda c: F.when(F.col("_n") == n, basis.combine([F.get("_w", k) for k in range(n)], [F.col(f"_{c}{k}") for k in range(n)]))
    return placed.select("elem_id", "k", F.struct(*(at(c).alias(c) for c in "xyz")).alias("p"))


def slice_plane(elements: DataFrame, nodes: DataFrame, at: tuple, normal: tuple, geometry: str) -> DataFrame:
    """(elem_id, edge, p): points where a plane cuts edges. nodes: (node_id, p)."""
    from ..functions import vec as v

    d = nodes.select("node_id", v.plane_distance(F.col("p"), vec(*at), vec(*normal)).alias("val"))
    hits = iso_crossings(elements, d, 0.0, geometry)
    a = nodes.select(F.col("node_id").alias("a"), F.col("p").alias("pa"))
    b = nodes.select(F.col("node_id").alias("b"), F.col("p").alias("pb"))
    return hits.join(a, "a").join(b, "b").select("elem_id", "edge", v.lerp(F.col("pa"), F.col("pb"), F.col("t")).alias("p"))


def triangulate(elements: DataFrame, geometry: str) -> DataFrame:
    """(elem_id, part, node_ids) of the triangles of every face; a face of four is split along its second diagonal."""
    split = F.when(F.size("node_ids") == 4, F.array(_pick("node_ids", (0, 1, 2)), _pick("node_ids", (1, 3, 2)))).otherwise(F.array("node_ids"))
    return faces(elements, geometry).select("elem_id", "face", F.posexplode(split).alias("part", "node_ids"))


def green_lagrange(dx: Column, dy: Column, dz: Column) -> list[list[Column]]:
    """Half of GᵀG - I; the rows of G are the three vectors."""
    rows = (dx, dy, dz)
    entry = lambda i, j: reduce(lambda a, b: a + b, (r[i] * r[j] for r in rows))
    return [[0.5 * (entry(i, j) - (1.0 if i == j else 0.0)) for j in "xyz"] for i in "xyz"]


def box_grid(spark: SparkSession, nx: int, ny: int, nz: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, elements) of nx × ny × nz hexahedra in the unit cube, x fastest; all from ranges."""
    mx, my = nx + 1, ny + 1
    i = F.col("id")
    x, y, z = i % mx, F.floor(i / mx) % my, F.floor(i / (mx * my))
    nodes = spark.range(mx * my * (nz + 1)).select(i.alias("node_id"), vec(x / nx, y / ny, z / nz).alias("p"))
    ex, ey, ez = i % nx, F.floor(i / nx) % ny, F.floor(i / (nx * ny))
    first = ex + ey * mx + ez * mx * my
    ids = F.array(*(first + a + b * mx + c * mx * my for c in (0, 1) for b in (0, 1) for a in (0, 1)))
    return nodes, spark.range(nx * ny * nz).select(i.alias("elem_id"), ids.alias("node_ids"))


def xi_template(geometry: str, refine: int) -> list[tuple[float, ...]]:
    """Places of an element refined so many times: the nodes of its linear refinement."""
    return [tuple(map(float, p)) for p in basis.node_positions(geometry, refine + 1)]


def line_template(elem_type: str, refine: int) -> list[tuple[float, list[float]]]:
    """Places along a line element cut into refine + 1 parts, with the weight of every node there."""
    geometry, order, _ = basis.element_type(elem_type)
    if geometry != "Line":
        raise ValueError(f"{elem_type} is no line")
    return [(float(x), basis.weights_at(geometry, order, (float(x),))) for x in np.linspace(0, 1, refine + 2)]


def face_template(elem_type: str, refine: int) -> list[tuple[int, tuple[float, ...], tuple[float, ...], list[float]]]:
    """(face, place on the face, place in the element, weight of every node) of the points of every face refined so many times."""
    geometry, order, _ = basis.element_type(elem_type)
    corners, out = basis.node_positions(geometry, 1), []
    for face, ids in enumerate(basis.face_nodes(geometry, 1)):
        kind = {2: "Line", 3: "Tri", 4: "Quad"}[len(ids)]
        first, arms = corners[ids[0]], corners[ids[1:3]] - corners[ids[0]]
        for place in basis.node_positions(kind, refine + 1):
            xi = tuple(map(float, first + place @ arms[: len(place)]))
            out.append((face, tuple(map(float, place)), xi, basis.weights_at(geometry, order, xi)))
    return out


def face_points(elements: DataFrame, nodes: DataFrame, elem_type: str, refine: int) -> DataFrame:
    """(elem_id, face, k, p): the points of the refined faces of elements. nodes: (node_id, p)."""
    template = face_template(elem_type, refine)
    places = F.array(*(F.lit(t[0]) for t in template))
    first = {f: min(k for k, t in enumerate(template) if t[0] == f) for f in {t[0] for t in template}}
    starts = F.array(*(F.lit(first[t[0]]) for t in template))
    found = positions(elements, nodes, elem_type, [t[2] for t in template])
    return found.select("elem_id", F.get(places, F.col("k")).alias("face"), (F.col("k") - F.get(starts, F.col("k"))).alias("k"), "p")


def of_regions(parts: DataFrame, parents: DataFrame, key: str, region: str, chosen: list) -> DataFrame:
    """Parts of elements whose parent lies in a chosen region, with that region; rows of other regions go before the join."""
    return parts.join(parents.where(F.col(region).isin(chosen)).select(key, region), key)


def evaluate_at(places: DataFrame, elements: DataFrame, values: DataFrame, elem_type: str) -> DataFrame:
    """(elem_id, point_id, val) of a field at stored places (elem_id, point_id, xi); null where a node has no value.

    Places go to their elements as plain numbers, not as arrays. Nodes are dealt by element before they are gathered, as in
    positions: few would meet before, and each would be sent in a list of its own."""
    dims = basis.GEOMETRIES[basis.element_type(elem_type)[0]][0]
    places = places.select("elem_id", "point_id", *(F.get("xi", k).alias(f"_xi{k}") for k in range(dims)))
    weights = F.array(*basis.lagrange(elem_type, [F.col(f"_xi{k}") for k in range(dims)]))
    corners = elements.select("elem_id", F.posexplode("node_ids").alias("k", "node_id")).join(values, "node_id", "left")
    corners = corners.select("elem_id", "k", "val").repartition("elem_id")
    corners = corners.groupBy("elem_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "val"))), lambda c: c["val"]).alias("vals"))
    total = F.aggregate(F.zip_with("vals", weights, lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return places.join(corners, "elem_id").select("elem_id", "point_id", total.alias("val"))


def positions_at(places: DataFrame, elements: DataFrame | None, nodes: DataFrame | None, elem_type: str) -> DataFrame:
    """places (elem_id, xi, ...) with p, the point there: nodes weighted by their functions; null where a node is missing. nodes: (node_id, p).

    Places that have the points of their element's nodes already, as cnodes, meet neither elements nor nodes."""
    from .spatial import with_corners

    dims = basis.GEOMETRIES[basis.element_type(elem_type)[0]][0]
    weights = F.array(*basis.lagrange(elem_type, [F.get("xi", k) for k in range(dims)]))
    joined = places if "cnodes" in places.columns else places.join(with_corners(elements, nodes).select("elem_id", "cnodes"), "elem_id")
    joined = joined.withColumn("_w", weights)
    total = lambda c: F.aggregate(F.zip_with("cnodes", "_w", lambda p, w: p[c] * w), F.lit(0.0), lambda s, v: s + v)
    return joined.withColumn("p", F.struct(*(total(c).alias(c) for c in "xyz"))).drop("cnodes", "_w")


def hermite_matrices(a: DataFrame, b: DataFrame, start: DataFrame, end: DataFrame, t: float) -> DataFrame:
    """Cell by cell the cubic from a to b at t, with tangents at both ends."""
    first, here, there, last = (float(w) for w in ((t**3 - 2 * t**2 + t), (2 * t**3 - 3 * t**2 + 1), (3 * t**2 - 2 * t**3), (t**3 - t**2)))
    named = [m.select("row_id", F.col("vals").alias(k)) for m, k in zip((a, b, start, end), ("_a", "_b", "_s", "_e"))]
    joined = reduce(lambda x, y: x.join(y, "row_id"), named)
    sums = F.transform(F.arrays_zip("_a", "_b", "_s", "_e"), lambda c: c["_a"] * here + c["_b"] * there + c["_s"] * first + c["_e"] * last)
    return joined.select("row_id", sums.alias("vals"))


def outer_faces(faces: DataFrame) -> DataFrame:
    """faces (elem_id, face, node_ids) whose nodes no other element has as a face; all of an element's equal faces stay."""
    keyed = faces.withColumn("_key", F.array_sort("node_ids"))
    alone = keyed.groupBy("_key").agg((F.min("elem_id") == F.max("elem_id")).alias("_alone")).where("_alone").select("_key")
    return keyed.join(alone, "_key", "left_semi").drop("_key")


def representation(elements: DataFrame, geometry: str, external_only: bool = True) -> DataFrame:
    """(elem_id, face, part, node_ids): the triangles that show a mesh, of its outer faces or of all."""
    found = outer_faces(faces(elements, geometry)) if external_only else faces(elements, geometry)
    split = F.when(F.size("node_ids") == 4, F.array(_pick("node_ids", (0, 1, 2)), _pick("node_ids", (1, 3, 2)))).otherwise(F.array("node_ids"))
    return found.select("elem_id", "face", F.posexplode(split).alias("part", "node_ids"))
