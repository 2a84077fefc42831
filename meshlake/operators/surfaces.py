"""Surfaces at values of a field and in planes, with vertices that triangles share, and surfaces lofted between contours."""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import basis, vec
from .mesh import EDGES
from .spatial import with_corners
from .stored import stored


def _outward_faces(geometry: str) -> list[list[int]]:
    """Corner lists of the faces of a volume element, counterclockwise as seen from outside."""
    places = basis.node_positions(geometry, 1)
    middle = places.mean(0)
    out = []
    for nodes in basis.face_nodes(geometry, 1):
        center = places[nodes].mean(0)
        arms = places[nodes] - center
        normal = np.cross(arms[0], arms[1] if abs(np.cross(arms[0], arms[1])).max() > 1e-9 else arms[2])
        normal = normal * np.sign(normal @ (center - middle))
        x = arms[0] / np.linalg.norm(arms[0])
        y = np.cross(normal / np.linalg.norm(normal), x)
        out.append([nodes[k] for k in np.argsort(np.arctan2(arms @ y, arms @ x) % (2 * np.pi - 1e-9))])
    return out


@cache
def case_table(geometry: str) -> list[list[list[int]]]:
    """For each set of corners above the value (bit k for corner k) the triangles, as three numbers of edges each.

    Around each face a run of corners above is cut off by a segment, from the edge where it ends to the edge where it
    began. This depends on the face alone, so neighbours agree and surfaces have no holes. The segments of all faces
    join to loops, and a loop is a fan of triangles that look to where the field is lower."""
    number = {frozenset(e): k for k, e in enumerate(EDGES[geometry])}
    faces = _outward_faces(geometry)
    corners = basis.node_positions(geometry, 1)
    table = []
    for case in range(1 << len(corners)):
        follow: dict[int, int] = {}
        for face in faces:
            above = [case >> k & 1 for k in face]
            edge = lambda i: number[frozenset((face[i], face[(i + 1) % len(face)]))]  # noqa: B023, E731
            for i in range(len(face)):
                if above[i] and not above[(i + 1) % len(face)]:
                    j = i
                    while above[j - 1]:
                        j -= 1
                    follow[edge(i)] = edge((j - 1) % len(face))
        triangles, left = [], set(follow)
        while left:
            loop = [min(left)]
            while (after := follow[loop[-1]]) != loop[0]:
                loop.append(after)
            left -= set(loop)
            triangles += [[loop[0], loop[k], loop[k + 1]] for k in range(1, len(loop) - 1)]
        table.append(triangles)
    # All faces are walked the same way, so one case tells whether all triangles look down.
    middles = np.array([corners[list(e)].mean(0) for e in EDGES[geometry]])
    a, b, c = middles[table[1][0]]
    if np.cross(b - a, c - a) @ (a - corners[0]) < 0:
        table = [[[x, z, y] for x, y, z in triangles] for triangles in table]
    return table


def iso_surface(elements: DataFrame, nodes: DataFrame, geometry: str, values: list[float]) -> DataFrame:
    """(elem_id, iso, part, a, b, c): the triangles at which a field has these values, in one pass over the elements.

    elements: (elem_id, node_ids) of Hex or Tet, nodes: (node_id, p, val). A vertex is a struct (low, high, p): it lies
    on the edge between two nodes and is named by them, so triangles of all elements share it with the same numbers.
    Triangles look to where the field is lower in elements whose corners turn right-handed, as the order of the library
    has them. Elements with a missing node have none."""
    table = F.from_json(F.lit(json.dumps(case_table(geometry))), "array<array<array<int>>>")
    ends = F.from_json(F.lit(json.dumps([list(e) for e in EDGES[geometry]])), "array<array<int>>")
    n = len(basis.node_positions(geometry, 1))
    named = nodes.select("node_id", F.struct("node_id", "p", "val").alias("p"))
    whole = with_corners(elements, named).where((F.size("cnodes") == n) & ~F.exists("cnodes", lambda c: c["val"].isNull()))
    wide = whole.select("elem_id", "cnodes", F.explode(F.lit([float(v) for v in values])).alias("iso"))
    case = sum((F.get("cnodes", k)["val"] > F.col("iso")).cast("int") * (1 << k) for k in range(n))
    crossed = wide.withColumn("_case", case).where((F.col("_case") > 0) & (F.col("_case") < (1 << n) - 1))
    parts = crossed.select("elem_id", "iso", "cnodes", F.posexplode(F.get(table, F.col("_case"))).alias("part", "_edges"))

    def vertex(k: int) -> Column:
        pair = F.get(ends, F.get("_edges", k))
        both = F.array_sort(F.array(*(F.get("cnodes", F.get(pair, j)) for j in (0, 1))))
        cut = lambda s: F.struct(F.get(s, 0)["node_id"].alias("low"), F.get(s, 1)["node_id"].alias("high"), _between(F.get(s, 0), F.get(s, 1)).alias("p"))
        return F.get(F.transform(F.array(both), cut), 0)

    def _between(a: Column, b: Column) -> Column:
        return vec.lerp(a["p"], b["p"], (F.col("iso") - a["val"]) / F.nullif(b["val"] - a["val"], F.lit(0.0)))

    return parts.select("elem_id", "iso", "part", *(vertex(k).alias(c) for k, c in enumerate("abc")))


def slice_surface(elements: DataFrame, nodes: DataFrame, geometry: str, at: Column, normal: Column) -> DataFrame:
    """The same where a plane cuts elements; nodes: (node_id, p). Triangles look against the normal."""
    return iso_surface(elements, nodes.withColumn("val", vec.plane_distance(F.col("p"), at, normal)), geometry, [0.0])


def vertices(triangles: DataFrame) -> DataFrame:
    """(iso, low, high, p): each vertex once."""
    wide = triangles.select("iso", F.explode(F.array("a", "b", "c")).alias("v"))
    return wide.groupBy("iso", "v.low", "v.high").agg(F.first("v.p").alias("p"))


def _clip(p: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles of a simple polygon of points (x, y), by cutting off ears; of what has no ear left, as in a polygon that crosses itself, a fan.

    A point in line with its neighbours goes first, as a triangle without area. An ear may not touch other points, as one
    on its open side would be left on a side of the rest, which then may have no ear; only in polygons that touch
    themselves it may, first in its corners, then anywhere."""
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    left, q = np.arange(len(p)), p.T
    if turn(np.zeros(2), np.roll(q, 1, 1), q).sum() < 0:
        left, q = left[::-1], q[:, ::-1]
    turns = turn(np.roll(q, 1, 1), q, np.roll(q, -1, 1))
    # What rounding leaves of an area of 0.
    none = 1e-12 * np.ptp(q, 1).max() ** 2 if len(p) else 0.0

    def ear(m: int, touching: int) -> bool:
        own = [m - 1, m, (m + 1) % len(left)]
        a, b, c = (q[:, e].tolist() for e in own)
        depth = np.minimum(np.minimum(turn(a, b, q), turn(b, c, q)), turn(c, a, q))
        depth[own] = -np.inf
        if touching == 2:
            return depth.max() <= none
        near = q[:, depth >= -none].T.tolist()
        return not near or touching == 1 and all(o in (a, b, c) for o in near)

    out, at = [], 0
    while (n := len(left)) > 3:
        flat = np.flatnonzero(np.abs(turns) <= none)
        if len(flat):
            m = int(flat[0])
        else:
            # The search goes on where the last ear was.
            tips = np.flatnonzero(turns > 0)
            first = int(np.searchsorted(tips, at))
            tips = [*tips[first:].tolist(), *tips[:first].tolist()]
            m = at = next((m for touching in range(3) for m in tips if ear(m, touching)), None)
        if m is None:
            return out + [(int(left[0]), int(left[m]), int(left[m + 1])) for m in range(1, n - 1)]
        out.append((int(left[m - 1]), int(left[m]), int(left[(m + 1) % n])))
        left, q, turns = np.delete(left, m), np.delete(q, m, 1), np.delete(turns, m)
        for e in (m - 1, m % (n - 1)):
            turns[e] = turn(q[:, e - 1].tolist(), q[:, e].tolist(), q[:, (e + 1) % (n - 1)].tolist())
    return out + ([tuple(left.tolist())] if len(left) == 3 else [])


def contour_triangles(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, a, b, c): triangles between the points (keys, at, p) of closed contours, also of those that are not star-shaped.

    A contour is seen along the axis nearest to its normal. It is one group, as long as a contour has points."""
    kinds = dict(points.dtypes)

    def clip(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        p = pdf[["x", "y", "z"]].to_numpy(float)
        normal = np.abs(np.cross(p, np.roll(p, -1, 0)).sum(0))
        found = _clip(np.delete(p, int(np.argmax(normal)), 1))
        flat = {f"{n}{c}": [p[f[m]][i] for f in found] for m, n in enumerate("abc") for i, c in enumerate("xyz")}
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(found) for k in keys} | {"t": range(len(found))} | flat)

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "t int", *(f"{n}{c} double" for n in "abc" for c in "xyz")])
    found = points.select(*keys, "at", "p.x", "p.y", "p.z").groupBy(*keys).applyInPandas(clip, schema)
    return found.select(*keys, "t", *(vec.vec(*(F.col(f"{n}{c}") for c in "xyz")).alias(n) for n in "abc"))


#: Rows of a lofted surface that are made at once.
BLOCK = 1000


def loft(rings: DataFrame, key: str, n: int, between: int, closed_at_end: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of the surface through rings of n points each, from the first ring to the last.

    rings: (key, level, k, p), level from 0 and k from 0 to n - 1, counted from the same side of every ring, as
    `volumes.resample_contour` gives them. Between two rings lie `between` more, on Catmull-Rom curves through the
    points of equal k (ends are doubled). nodes: (key, row, k, p); closed_at_end adds the last ring's middle as an apex,
    with k 0 in a row of its own. triangles: (key, row, k, part, a, b, c) with corners as structs (row, k); all wind
    the same way, and but for the first ring every edge has two."""
    by = Window.partitionBy(key, "k").orderBy("level")
    around = {"_p0": F.coalesce(F.lag("p").over(by), F.col("p")), "_p2": F.lead("p").over(by)}
    around["_p3"] = F.coalesce(F.lead("p", 2).over(by), F.lead("p").over(by))
    curves = rings.select(key, "level", "k", "p").withColumns(around)
    steps = F.when(F.col("_p2").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(between)))
    placed = curves.withColumn("_j", F.explode(steps)).withColumn("_t", F.col("_j") / float(between + 1))
    weights = basis.catmull_rom(F.col("_t"))
    mixed = vec.vec(*(basis.combine(weights, [F.col(f"{q}.{c}") for q in ("_p0", "p", "_p2", "_p3")]) for c in "xyz"))
    nodes = placed.select(key, (F.col("level") * (between + 1) + F.col("_j")).cast("bigint").alias("row"), F.col("k").cast("bigint").alias("k"), F.when(F.col("_j") == 0, F.col("p")).otherwise(mixed).alias("p"))
    last = rings.groupBy(key).agg((F.max("level") * (between + 1)).cast("bigint").alias("_last"))
    if closed_at_end:
        ends = rings.groupBy(key, "level").agg(*(F.avg(f"p.{c}").alias(c) for c in "xyz")).groupBy(key).agg(F.max_by(F.struct("x", "y", "z"), "level").alias("p"))
        nodes = nodes.unionByName(ends.join(last, key).select(key, (F.col("_last") + 1).alias("row"), F.lit(0).cast("bigint").alias("k"), "p"))
    # A key's rows are made by many tasks: first their blocks, dealt to tasks, then the rows of a block.
    last = stored(last)
    top, whole = F.col("_last") - (0 if closed_at_end else 1), last.agg(F.sum("_last")).first()[0] or 0
    tasks = max(1, -(-int(whole) // BLOCK), int(last.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = last.withColumn("_first", F.explode(F.when(top >= 0, F.sequence(F.lit(0).cast("bigint"), top, F.lit(BLOCK).cast("bigint"))))).repartition(tasks, key, "_first")
    cells = blocks.select(key, "_last", F.explode(F.sequence("_first", F.least(F.col("_first") + (BLOCK - 1), top))).alias("row")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("k"))
    at = lambda up, on: F.struct((F.col("row") + up).alias("row"), ((F.col("k") + on) % n).alias("k"))
    apex = F.struct((F.col("row") + 1).alias("row"), F.lit(0).cast("bigint").alias("k"))
    triangle = lambda *c: F.struct(*(x.alias(m) for x, m in zip(c, "abc")))
    square = F.array(triangle(at(0, 0), at(0, 1), at(1, 0)), triangle(at(0, 1), at(1, 1), at(1, 0)))
    cap = F.array(triangle(at(0, 0), at(0, 1), apex))
    faces = cells.select(key, "row", "k", F.posexplode(F.when(F.col("row") < F.col("_last"), square).otherwise(cap)).alias("part", "_t"))
    return nodes, faces.select(key, "row", "k", "part", "_t.*")
