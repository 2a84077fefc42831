"""Generated meshes: spheres, hemispheres, planes, circles and tubes, as templates for the rows of a table.

A template is (nodes, triangles): nodes (k, p), triangles (t, corners) with corners as
numbers of nodes. `placed` puts one at every row; templates are made by Spark from ranges.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vec
from .matrix import dense_ids


def icosahedron() -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The twelve corners, one of them up, and the twenty faces, counterclockwise from outside."""
    gold = (1 + 5**0.5) / 2
    corners = np.array([np.roll((0.0, a, b * gold), k) for k in range(3) for a in (1, -1) for b in (1, -1)])
    up = corners[0] / np.linalg.norm(corners[0])
    side = np.cross([1.0, 0.0, 0.0], up)
    corners = corners @ np.array([[1.0, 0.0, 0.0], -side, up]).T
    near = lambda i, j: abs(np.linalg.norm(corners[i] - corners[j]) - 2) < 1e-9
    faces = [f for f in itertools.combinations(range(12), 3) if all(near(i, j) for i, j in itertools.combinations(f, 2))]
    return corners, [f if np.linalg.det(corners[list(f)]) > 0 else (f[0], f[2], f[1]) for f in faces]


def sphere(spark: SparkSession, refine: int = 0) -> tuple[DataFrame, DataFrame]:
    """A unit sphere of 20 × 4**refine triangles: the faces of an icosahedron cut into equal triangles, their corners moved out to the sphere."""
    corners, faces = icosahedron()
    n = 1 << refine
    cells = spark.range(20 * n * n).select(F.col("id").alias("t"), F.floor(F.col("id") / (n * n)).cast("int").alias("face"), (F.col("id") % (n * n)).alias("i"))
    # Row r of a face has 2r + 1 triangles, every second one upside down.
    cells = cells.withColumn("r", F.floor(F.sqrt(F.col("i") + 0.5)).cast("int")).withColumn("c", (F.col("i") - F.col("r") * F.col("r")).cast("int"))
    half, odd = F.floor(F.col("c") / 2).cast("int"), F.col("c") % 2 == 1
    at = lambda a, b: F.struct((F.lit(n) - a).alias("u"), (a - b).alias("v"), b.alias("w"))
    r = F.col("r")
    places = F.when(odd, F.array(at(r, half), at(r + 1, half + 1), at(r, half + 1))).otherwise(F.array(at(r, half), at(r + 1, half), at(r + 1, half + 1)))
    face = F.get(F.lit([list(f) for f in faces]), F.col("face"))
    # A corner is named by the corners of the icosahedron that it lies between, so that faces share it.
    def name(p: Column) -> Column:
        parts = F.filter(F.array(*(F.struct(F.get(face, k).alias("k"), p[c].alias("n")) for k, c in enumerate("uvw"))), lambda x: x["n"] > 0)
        return F.array_sort(parts)

    named = cells.select("t", F.transform(places, name).alias("corners")).select("t", F.posexplode("corners").alias("j", "name"))
    nodes = dense_ids(named.select("name").distinct(), ["name"], "k")
    table = F.lit(corners.tolist())
    total = vec.vec(*(F.aggregate(F.transform("name", lambda x: F.get(F.get(table, x["k"]), F.lit(i)) * x["n"]), F.lit(0.0), lambda s, v: s + v) for i in range(3)))
    triangles = named.join(nodes.select("name", "k"), "name").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "k"))), lambda x: x["k"]).alias("corners"))
    return nodes.select("k", vec.norm(total).alias("p")), triangles


def hemisphere(spark: SparkSession, refine: int = 0) -> tuple[DataFrame, DataFrame]:
    """The triangles of a sphere refined once more that lie on or over the plane z = 0; nodes are numbered anew."""
    nodes, triangles = sphere(spark, refine + 1)
    over = nodes.where("p.z >= -1e-10")
    wide = triangles.select("t", F.posexplode("corners").alias("j", "k")).join(over.select("k"), "k")
    kept = wide.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("j", "k"))).alias("c")).where("size(c) = 3")
    used = kept.select(F.explode("c.k").alias("k")).distinct()
    numbers = dense_ids(used, ["k"], "_new")
    again = kept.select("t", F.explode("c").alias("x")).select("t", "x.j", "x.k").join(numbers, "k").groupBy("t").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "_new"))), lambda x: x["_new"]).alias("corners"))
    return over.join(numbers, "k").select(F.col("_new").alias("k"), "p"), dense_ids(again, ["t"], "_t").select(F.col("_t").alias("t"), "corners")


def plane(spark: SparkSession, refine: int = 0) -> tuple[DataFrame, DataFrame]:
    """A unit square around the origin, facing up, of 2 (refine + 1)² triangles whose long sides point to the middle."""
    n = refine + 1
    i = F.col("id")
    x, y = i % (n + 1), F.floor(i / (n + 1))
    nodes = spark.range((n + 1) ** 2).select(i.alias("k"), vec.vec(x / n - 0.5, (n - y) / n - 0.5, 0.0).alias("p"))
    col, row = i % n, F.floor(i / n)
    a = row * (n + 1) + col
    b, c, d = a + 1, a + n + 1, a + n + 2
    middle = (n - 1) / 2
    mirrored = (row < middle) == (col < middle)
    pair = F.when(mirrored, F.array(F.array(a, c, b), F.array(b, c, d))).otherwise(F.array(F.array(b, a, d), F.array(a, c, d)))
    parts = spark.range(n * n).select(i.alias("cell"), F.posexplode(pair).alias("part", "corners"))
    return nodes, parts.select((F.col("cell") * 2 + F.col("part")).alias("t"), "corners")


def circle(spark: SparkSession, spokes: int, radius: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """At least three points counterclockwise around the origin and the origin as the last one, with the triangles between."""
    n = max(3, spokes)
    i = F.col("id")
    angle = i * (2 * math.pi / n)
    rim = F.when(i < n, vec.vec(F.cos(angle) * radius, F.sin(angle) * radius, 0.0)).otherwise(vec.vec(0, 0, 0))
    return spark.range(n + 1).select(i.alias("k"), rim.alias("p")), spark.range(n).select(i.alias("t"), F.array(F.lit(n).cast("bigint"), i, (i + 1) % n).alias("corners"))


def placed(template: tuple[DataFrame, DataFrame], rows: DataFrame, key: str, center: Column, scale: Column) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of a template at every row: nodes (key, k, p), triangles (key, t, corners). The product with the template is what is asked for."""
    nodes, triangles = template
    where = rows.select(key, center.alias("_at"), scale.alias("_by"))
    moved = where.crossJoin(nodes).select(key, "k", vec.add(F.col("_at"), vec.scale(F.col("p"), F.col("_by"))).alias("p"))
    return moved, rows.select(key).crossJoin(triangles)


def tubes(lines: DataFrame, key: str, spokes: int, rows_per_task: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of tubes along lines (key, at, p, radius): a ring of points around each point of a line, across the
    mean direction of the pieces beside it. nodes: (key, ring, k, p), triangles: (key, ring, k, part, corners as structs
    (ring, k)). Rings start at the side that looks away from the line's middle, so that tubes are not twisted.

    Rings are dealt by line and number before their points are made, to tasks of about rows_per_task points: a ring is
    sent once, not each of its points, a long line's points come from many tasks, and what joins or gathers nodes by ring
    finds them together."""
    tasks = max(1, -(-lines.count() * spokes // rows_per_task))
    by = Window.partitionBy(key).orderBy("at")
    middle = lines.groupBy(key).agg(*(F.avg(f"p.{c}").alias(c) for c in "xyz")).select(key, vec.vec(F.col("x"), F.col("y"), F.col("z")).alias("_m"))
    d = lines.select(key, "at", "p", "radius", F.lag("p").over(by).alias("_a"), F.lead("p").over(by).alias("_b"), (F.row_number().over(by) - 1).cast("bigint").alias("ring"))
    back, on = vec.sub(F.col("p"), F.col("_a")), vec.sub(F.col("_b"), F.col("p"))
    way = F.when(F.col("_a").isNull(), on).when(F.col("_b").isNull(), back).otherwise(vec.add(back, on))
    # Points without a direction go before it is made a unit: the filter moves down with all that it is made of.
    d = d.join(middle, key).withColumn("_w", way).where("_w.x is not null").withColumn("_d", vec.norm(F.col("_w")))
    rings = d.select(key, "ring", "p", "radius", "_d", "_m").repartition(tasks, key, "ring")
    away = vec.sub(F.col("p"), F.col("_m"))
    flat = vec.cross(F.col("_d"), away)
    other = vec.cross(F.col("_d"), F.when(F.abs(F.col("_d.z")) < 0.9, vec.vec(0, 0, 1)).otherwise(vec.vec(1, 0, 0)))
    rings = rings.withColumn("_v", vec.norm(F.when(vec.length(flat) > 1e-9, flat).otherwise(other))).withColumn("_u", vec.cross(F.col("_v"), F.col("_d")))
    wide = rings.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spokes - 1).cast("bigint"))))
    angle = F.col("k") * (2 * math.pi / spokes)
    nodes = wide.select(key, "ring", "k", vec.add(F.col("p"), vec.add(vec.scale(F.col("_u"), F.col("radius") * F.cos(angle)), vec.scale(F.col("_v"), F.col("radius") * F.sin(angle)))).alias("p"))
    last = d.groupBy(key).agg(F.max("ring").alias("_last")).where("_last > 0")
    cells = last.withColumn("ring", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last") - 1))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(spokes - 1).cast("bigint"))))
    at = lambda up, step: F.struct((F.col("ring") + up).alias("ring"), ((F.col("k") + step) % spokes).alias("k"))
    pair = F.array(F.array(at(0, 0), at(0, 1), at(1, 0)), F.array(at(0, 1), at(1, 1), at(1, 0)))
    return nodes, cells.select(key, "ring", "k", F.posexplode(pair).alias("part", "corners"))


def ribbons(lines: DataFrame, key: str, normal: Column, width: float) -> DataFrame:
    """(key, at, a, b, c, d): the square along each piece of a line (key, at, p), so wide and across a normal; a and b lie beside its start, c and d beside its end."""
    by = Window.partitionBy(key).orderBy("at")
    pieces = lines.withColumns({"_q": F.lead("p").over(by), "_n": normal}).where("_q is not null")
    side = vec.scale(vec.norm(vec.cross(F.col("_n"), vec.sub(F.col("_q"), F.col("p")))), width / 2)
    pieces = pieces.withColumn("_s", side)
    corner = lambda f, p: f(F.col(p), F.col("_s"))
    return pieces.select(key, "at", corner(vec.sub, "p").alias("a"), corner(vec.add, "p").alias("b"), corner(vec.sub, "_q").alias("c"), corner(vec.add, "_q").alias("d"))


def billboards(points: DataFrame, key: str, right: Column, up: Column, size: Column) -> DataFrame:
    """(key, a, b, c, d): a square around each point (key, p) that faces a viewer with these directions."""
    half = F.col("_h")
    named = points.withColumns({"_r": right, "_u": up, "_h": size / 2})
    corner = lambda x, y: vec.add(F.col("p"), vec.add(vec.scale(F.col("_r"), half * x), vec.scale(F.col("_u"), half * y)))
    return named.select(key, *(corner(x, y).alias(n) for n, (x, y) in zip("abcd", ((-1.0, -1.0), (1.0, -1.0), (-1.0, 1.0), (1.0, 1.0)))))
