"""Rays, boxes, planes, octrees, element selection and search, over embeddings as points, triangles and tetrahedra."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars, vec
from ..operators import agg, mesh, spatial
from .geometry_queries import FANS, POINTS, out, points
from .registry import query, table


@query("ray_points", POINTS + """, n AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS l FROM e), f AS (SELECT *, ((rx - px) * qx + (ry - py) * qy + (rz - pz) * qz) / l AS t FROM n)
SELECT vec_id, round(t, 6) AS along, round(px + qx / l * 2, 6) AS at_x, round(pz + qz / l * 2, 6) AS at_z FROM f""")
def _(spark, d):
    n = points(spark, d).withColumn("n", vec.norm(F.col("q")))
    at = vec.ray_at(F.col("p"), F.col("n"), 2.0)
    return out(n, along=vec.ray_project(F.col("p"), F.col("n"), F.col("r")), at_x=at["x"], at_z=at["z"])


@query("ray_mesh", POINTS + """, h AS (SELECT *, qx - px AS ex, qy - py AS ey, qz - pz AS ez, rx - px AS fx, ry - py AS fy, rz - pz AS fz FROM e),
a AS (SELECT *, ex * -fy + ey * fx AS det, -0.01 - px AS ox, 0.0 - py AS oy, -5.0 - pz AS oz FROM h WHERE abs(ex * -fy + ey * fx) > 1e-10),
u AS (SELECT *, (ox * -fy + oy * fx) / det AS u, (ox * ey - oy * ex) / det AS v, (fx * (oy * ez - oz * ey) + fy * (oz * ex - ox * ez) + fz * (ox * ey - oy * ex)) / det AS t FROM a)
SELECT vec_id AS tri_id, round(t, 6) AS t, round(u, 6) AS u, round(v, 6) AS v FROM u WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t >= 0 ORDER BY vec_id LIMIT 20""")
def _(spark, d):
    """The first 20 hits by triangle: the limit is the feature."""
    triangles = points(spark, d).select(F.col("vec_id").alias("tri_id"), F.col("p").alias("a"), F.col("q").alias("b"), F.col("r").alias("c"))
    hits = spatial.ray_hits(triangles, vec.vec(-0.01, 0, -5), vec.vec(0, 0, 1))
    return spatial.first_hits(hits, 20).select("tri_id", *(F.round(f"hit.{k}", 6).alias(k) for k in "tuv"))


@query("box_relations", POINTS + """, b AS (SELECT vec_id, least(px, qx) AS ax, least(py, qy) AS ay, least(pz, qz) AS az, greatest(px, qx) AS bx, greatest(py, qy) AS by_, greatest(pz, qz) AS bz FROM e)
SELECT vec_id, ax > -0.1 - 1e-10 AND ay > -0.1 - 1e-10 AND az > -0.1 - 1e-10 AND bx < 0.1 + 1e-10 AND by_ < 0.1 + 1e-10 AND bz < 0.1 + 1e-10 AS contained,
ax <= 0.1 AND bx >= -0.1 AND ay <= 0.1 AND by_ >= -0.1 AND az <= 0.1 AND bz >= -0.1 AS overlaps,
(abs(ax) < 0.1 + 1e-10 OR abs(bx) < 0.1 + 1e-10) AND (abs(ay) < 0.1 + 1e-10 OR abs(by_) < 0.1 + 1e-10) AND (abs(az) < 0.1 + 1e-10 OR abs(bz) < 0.1 + 1e-10) AS has_corner, round(greatest(-0.1, least(0.1, bx)), 6) AS cut_x FROM b""")
def _(spark, d):
    low, high = vec.vec(*[-0.1] * 3), vec.vec(*[0.1] * 3)
    ends = points(spark, d).withColumns({"a": vec._each(F.least, F.col("p"), F.col("q")), "b": vec._each(F.greatest, F.col("p"), F.col("q"))})
    a, b = F.col("a"), F.col("b")
    return ends.select("vec_id", vec.box_contains(low, high, a, b).alias("contained"), vec.box_overlaps(low, high, a, b).alias("overlaps"), vec.box_has_corner(low, high, a, b).alias("has_corner"), F.round(vec.box_intersection(low, high, a, b)[1]["x"], 6).alias("cut_x"))


@query("vec_components", POINTS + """SELECT vec_id, round(abs(px), 6) AS absolute, round(greatest(-0.05, least(0.05, py)), 6) AS clamped, round(CASE WHEN pz = 0 THEN 0 ELSE 1 / pz END, 4) AS inverse, CASE WHEN px >= 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS sign,
round(px + (qx - px) * 0.25, 6) AS lerp, px < qx AND py < qy AND pz < qz AS less, abs(px) < 1e-8 AS zero, greatest(0 + 1e-7, least(1 - 1e-7, px)) AS inside,
abs(px - rx) <= 0.2 AND abs(py - ry) <= 0.3 AND abs(pz - rz) <= 0.1 AS in_box, sign((qx - px) * (ry - py) - (qy - py) * (rx - px))::DOUBLE AS turn FROM e""")
def _(spark, d):
    p, q, r = F.col("p"), F.col("q"), F.col("r")
    shape = vec.in_oriented_box(p, r, vec.vec(0.2, 0, 0), vec.vec(0, 0.3, 0), vec.vec(0, 0, 0.1))
    six = lambda c: F.round(c, 6)
    return points(spark, d).select(
        "vec_id", six(vec.absolute(p)["x"]).alias("absolute"), six(vec.clamp(p, vec.vec(*[-0.05] * 3), vec.vec(*[0.05] * 3))["y"]).alias("clamped"), F.round(vec.inverse(p)["z"], 4).alias("inverse"), vec.sign(p)["x"].alias("sign"),
        six(vec.lerp(p, q, 0.25)["x"]).alias("lerp"), vec.less(p, q).alias("less"), scalars.is_zero(p["x"]).alias("zero"), scalars.clamp_inside(p["x"], 0.0, 1.0).alias("inside"), shape.alias("in_box"), vec.winding(p, q, r, vec.vec(0, 0, 1)).alias("turn"),
    )


@query("function_registries", "SELECT event_id, round(value - floor(value), 8) AS linear, 1.0::DOUBLE AS one, 0.0::DOUBLE AS zero, 0.0::DOUBLE AS zero_x, round(sqrt(value * value + 9), 6) AS uniform_y FROM events")
def _(spark, d):
    t, row = F.col("value") - F.floor("value"), F.array("value", F.lit(3.0))
    units, vectors = scalars.UNIT_FUNCTIONS, scalars.VECTOR_FUNCTIONS
    return table(spark, d, "events").select("event_id", F.round(units["linear"](t), 8).alias("linear"), units["one"](t).alias("one"), units["zero"](t).alias("zero"), vectors["zero"](row)["x"].alias("zero_x"), F.round(vectors["uniform"](row)["y"], 6).alias("uniform_y"))


@query("ray_shapes", POINTS + """, h AS (SELECT *, pz * pz + qz * qz AS keep FROM e) SELECT vec_id, round((0.3 - pz) / CASE WHEN abs(qz) > 1e-10 THEN qz END, 4) AS plane_t, abs(px) <= 0.1 AND abs(py) <= 0.1 AND pz <= 0.1 AS hits_box FROM h""")
def _(spark, d):
    p = F.col("p")
    plane = vec.ray_plane(p, F.col("q"), vec.vec(0, 0, 0.3), vec.vec(0, 0, 1))
    box = vec.ray_box(p, vec.vec(0, 0, 1), vec.vec(*[-0.1] * 3), vec.vec(*[0.1] * 3))
    return points(spark, d).select("vec_id", F.round(plane, 4).alias("plane_t"), box.isNotNull().alias("hits_box"))


_MATRIX = "[[px * px + 0.01, px * py, px * pz], [px * py, py * py + 0.01, py * pz], [px * pz, py * pz, pz * pz - 0.01]]"


@query("positive_definite", POINTS + f""", m AS (SELECT vec_id, {_MATRIX} AS m FROM e), d AS (SELECT vec_id, m[1][1] AS a, m[2][2] AS b, m[3][3] AS c, m[1][1] * m[2][2] - m[1][2] * m[2][1] AS ab, m[1][1] * m[3][3] - m[1][3] * m[3][1] AS ac, m[2][2] * m[3][3] - m[2][3] * m[3][2] AS bc,
m[1][1] * (m[2][2] * m[3][3] - m[2][3] * m[3][2]) - m[1][2] * (m[2][1] * m[3][3] - m[2][3] * m[3][1]) + m[1][3] * (m[2][1] * m[3][2] - m[2][2] * m[3][1]) AS abc FROM m)
SELECT vec_id, a >= 0 AND b >= 0 AND c >= 0 AND ab >= 0 AND ac >= 0 AND bc >= 0 AND abc >= 0 AS positive, round(abc, 8) AS det FROM d""")
def _(spark, d):
    p = F.col("p")
    m = [[p[i] * p[j] + (0.0 if i != j else -0.01 if i == "z" else 0.01) for j in "xyz"] for i in "xyz"]
    return points(spark, d).select("vec_id", vec.is_positive(m).alias("positive"), F.round(vec.determinant(m), 8).alias("det"))


@query("plane_xi", POINTS + """SELECT vec_id, round((py - 0.2) / 10, 6) AS xi_x, round((px - 0.1) / 20, 6) AS xi_y, round(pz - 0.3, 6) AS xi_z, round(px, 6) AS back_x, round(0.1 + (vec_id + 0.5) * 0.5, 6) AS pixel_x, round(0.2 + 2.5 * 2, 6) AS pixel_y FROM e""")
def _(spark, d):
    at, q = vec.vec(0.1, 0.2, 0.3), vec.constant_rotation((0, 0, 1), math.pi / 2)
    xi = points(spark, d).withColumn("xi", vec.plane_xi(F.col("p"), at, q, 10, 20))
    pixel = vec.pixel_position(F.col("vec_id"), 2, at, q, 2.0, 0.5)
    return out(xi, xi_x=F.col("xi.x"), xi_y=F.col("xi.y"), xi_z=F.col("xi.z"), back_x=vec.plane_position(F.col("xi"), at, q, 10, 20)["x"], pixel_x=pixel["x"], pixel_y=pixel["y"])


_leaf = lambda c: f"(least(7, greatest(0, floor((p{c} + 0.5) * 8)))::BIGINT)"
LEAVES = POINTS + ", c AS (SELECT vec_id, label, " + ", ".join(f"{_leaf(c)} AS {n}" for c, n in zip("xyz", "ijk")) + " FROM e), l AS (SELECT *, " + " + ".join(f"(({n} >> {b} & 1) << {3 * b + k})" for b in range(3) for k, n in enumerate("ijk")) + " AS leaf FROM c) "


def leaf_points(spark, d):
    return points(spark, d).withColumn("leaf", spatial.leaf_key(F.col("p"), (-0.5,) * 3, (0.5,) * 3, 3))


@query("octree_plane_leaves", LEAVES + "SELECT leaf, count(*) AS n FROM l WHERE (i + j + k) / 8.0 - 1.5 <= 0.05 AND (i + j + k + 3) / 8.0 - 1.5 >= 0.05 GROUP BY leaf")
def _(spark, d):
    leaves = leaf_points(spark, d).groupBy("leaf").agg(F.count("*").alias("n"))
    return spatial.leaves_cut_by_plane(leaves, vec.vec(0.05, 0, 0), vec.vec(1, 1, 1), (-0.5,) * 3, (0.5,) * 3, 3)


@query("octree_merge", LEAVES + "SELECT leaf, count(*) AS n, min(vec_id) AS first_id FROM l WHERE label % 2 = 0 OR vec_id % 3 = 0 GROUP BY leaf")
def _(spark, d):
    rows = leaf_points(spark, d)
    by_leaf = lambda x: x.groupBy("leaf").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    a, b = by_leaf(rows.where("label % 2 = 0")), by_leaf(rows.where("label % 2 <> 0 and vec_id % 3 = 0"))
    return spatial.merge_leaves(a, b, {"n": F.sum("n"), "first_id": F.min("first_id")})


def part_elements(spark, d):
    """(elem_id, node_ids, quantity): an order's parts as an element of nodes; (node_id, p): parts with price, size and number as coordinates."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("elem_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda c: c["l_partkey"]).alias("node_ids"), F.sum("l_quantity").alias("quantity"))
    part = table(spark, d, "part")
    return lines, part.select(F.col("p_partkey").alias("node_id"), vec.vec(F.col("p_retailprice"), F.col("p_size").cast("double"), F.col("p_partkey").cast("double")).alias("p"))


@query("element_where", """SELECT l_orderkey AS elem_id, count(*) AS n_nodes FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING max(p_size) >= 45 AND sum(l_quantity) > 50""")
def _(spark, d):
    found = spatial.select_elements(*part_elements(spark, d), "exists(cnodes, p -> p.y >= 45) and quantity > 50")
    return found.select("elem_id", F.size("node_ids").cast("bigint").alias("n_nodes"))


@query("locate_points", POINTS + """, t AS (SELECT vec_id AS elem_id, px AS ax, py AS ay, pz AS az, qx - px AS ux, qy - py AS uy, qz - pz AS uz, rx - px AS vx, ry - py AS vy, rz - pz AS vz, sx - px AS wx, sy - py AS wy, sz - pz AS wz FROM e),
j AS (SELECT e.vec_id AS id, t.*, e.qx - ax AS x, e.ry - ay AS y, e.sz - az AS z, ux * (vy * wz - vz * wy) + uy * (vz * wx - vx * wz) + uz * (vx * wy - vy * wx) AS det FROM e, t WHERE e.vec_id % 320 = 0),
k AS (SELECT id, elem_id, (x * (vy * wz - vz * wy) + y * (vz * wx - vx * wz) + z * (vx * wy - vy * wx)) / det AS a, (ux * (y * wz - z * wy) + uy * (z * wx - x * wz) + uz * (x * wy - y * wx)) / det AS b,
(ux * (vy * z - vz * y) + uy * (vz * x - vx * z) + uz * (vx * y - vy * x)) / det AS c FROM j)
SELECT id, elem_id, round(a, 4) AS xi_x, round(b, 4) AS xi_y FROM k WHERE least(a, b, c) >= -1e-9 AND a + b + c <= 1 + 1e-9""")
def _(spark, d):
    """A stated query set, the first point of each twentieth vector, against all tetrahedra."""
    pts = points(spark, d)
    tets = pts.select(F.col("vec_id").alias("elem_id"), *(F.col(c).alias(n) for c, n in zip("pqrs", "abcd")))
    asked = pts.where("vec_id % 320 = 0").select(F.col("vec_id").alias("id"), vec.vec(F.col("q.x"), F.col("r.y"), F.col("s.z")).alias("p"))
    found = spatial.locate(asked, tets, 0.1)
    return found.select("id", "elem_id", F.round("xi.x", 4).alias("xi_x"), F.round("xi.y", 4).alias("xi_y"))


@query("region_elements", """SELECT o_custkey % 5 AS region, l_orderkey AS tri_elem, l_linenumber AS part FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 IN (1, 3)""")
def _(spark, d):
    parents = table(spark, d, "orders").select(F.col("o_orderkey").alias("tri_elem"), (F.col("o_custkey") % 5).alias("region"))
    tris = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("tri_elem"), F.col("l_linenumber").alias("part"))
    return mesh.of_regions(tris, parents, "tri_elem", "region", [1, 3]).select("region", "tri_elem", "part")


@query("reinterpolate", FANS + """, v AS (SELECT elem_id, a.p_retailprice AS a, b.p_retailprice AS b, c.p_retailprice AS c FROM t JOIN part a ON a.p_partkey = ids[1] JOIN part b ON b.p_partkey = ids[2] JOIN part c ON c.p_partkey = ids[3]),
p AS (SELECT l_orderkey AS key, l_linenumber AS point_id, l_discount * 2 AS x, l_tax * 2 AS y FROM lineitem)
SELECT elem_id, point_id, round((1 - x - y) * a + x * b + y * c, 4) AS val FROM p JOIN v ON elem_id // 100 = key""")
def _(spark, d):
    from .geometry_queries import triangles

    values = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("val"))
    fans = triangles(spark, d)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("point_id"), F.array(F.col("l_discount") * 2, F.col("l_tax") * 2).alias("xi"))
    stored_xi = lines.join(fans.select("elem_id", F.floor(F.col("elem_id") / 100).alias("key")), "key").select("elem_id", "point_id", "xi")
    return mesh.evaluate_at(stored_xi, fans, values, "Tri1NL").select("elem_id", "point_id", F.round("val", 4).alias("val"))


@query("free_form", POINTS + """, b AS (SELECT vec_id, px, (px + 0.5) AS x, (py + 0.5) AS y, (pz + 0.5) AS z FROM e)
SELECT vec_id, round(CASE WHEN x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND z BETWEEN 0 AND 1 THEN (1 - x) ** 2 * -0.5 + 2 * x * (1 - x) * (0.25 * y) + x ** 2 * 0.5 ELSE px END, 6) AS moved_x FROM b""")
def _(spark, d):
    lattice = [[[(-0.5, 0, 0), (0.25 * j, 0, 0), (0.5, 0, 0)] for j in (0, 1)] for _ in (0, 1)]
    moved = spatial.free_form(F.col("p"), (-0.5,) * 3, (0.5,) * 3, lattice)
    return out(points(spark, d), moved_x=moved["x"])


@query("blue_noise", """WITH p AS (SELECT event_id AS id, value AS x, minute(ts) + second(ts) / 60.0::DOUBLE AS y, ('0x' || substr(md5(event_id::VARCHAR), 1, 8))::BIGINT AS w FROM events)
SELECT id, round(x, 6) AS x, round(y, 6) AS y FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE abs(q.x - p.x) < 2 AND (q.x - p.x) ** 2 + (q.y - p.y) ** 2 < 4 AND (q.w < p.w OR (q.w = p.w AND q.id < p.id)))""")
def _(spark, d):
    w = F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("x"), (F.minute("ts") + F.second("ts") / 60.0).alias("y"), w.alias("w"))
    found = spatial.thin_points(e, 2.0, "w")
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("nearest_plane", POINTS + """, k AS (SELECT vec_id, px, pz, label, s, abs(pz - (s * 0.02 - 0.1 + (label % 3) * 0.001)) AS dist FROM e, range(0, 11) t(s)), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, s) = 1)
SELECT vec_id, s AS plane_id, round(dist, 6) AS d, round(s * 0.02 - 0.1 + (label % 3) * 0.001, 6) AS z FROM b""")
def _(spark, d):
    e = points(spark, d)
    labels = e.select("label").distinct()
    planes = labels.select("label", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"))).alias("plane_id"))
    planes = planes.select("label", "plane_id", vec.vec(0, 0, F.col("plane_id") * 0.02 - 0.1 + (F.col("label") % 3) * 0.001).alias("at"), vec.vec(0, 0, 1).alias("normal"))
    found = spatial.nearest_plane(e, planes, "label")
    return found.select("vec_id", "plane_id", F.round("plane_distance", 6).alias("d"), F.round("projected.z", 6).alias("z"))


@query("glyphs", POINTS + "SELECT vec_id, round(qx / sqrt(qx * qx + qy * qy + qz * qz), 6) AS dir_x, round(sqrt(qx * qx + qy * qy + qz * qz), 6) AS scale FROM e")
def _(spark, d):
    found = spatial.glyphs(points(spark, d), F.col("q"), scalars.magnitude_of(F.array("q.x", "q.y", "q.z")))
    return out(found, dir_x=F.col("direction.x"), scale=F.col("scale"))


@query("directional_fields", POINTS + ", r AS (SELECT *, sqrt((px - 0.01) ** 2 + py ** 2) AS l FROM e) SELECT vec_id, 1.0::DOUBLE AS long_z, round((px - 0.01) / l, 6) AS radial_x, round(-py / l, 6) AS circ_x FROM r")
def _(spark, d):
    found = spatial.directional_fields(points(spark, d), vec.vec(0.01, 0, 0), vec.vec(0.01, 0, 2))
    return out(found, long_z=F.col("longitudinal.z"), radial_x=F.col("radial.x"), circ_x=F.col("circumferential.x"))


@query("torsion", POINTS + """, t AS (SELECT label, label % 2 AS part, degrees(atan2(px * qy - py * qx, px * qx + py * qy)) AS twist FROM e), m AS (SELECT (label // 2)::BIGINT AS object, avg(twist) FILTER (part = 0) AS base, avg(twist) FILTER (part = 1) AS apex FROM t GROUP BY 1)
SELECT object, round(apex - base, 4) AS twist, round((apex - base) / 80, 6) AS torsion FROM m""")
def _(spark, d):
    turned = points(spark, d).select(F.floor(F.col("label") / 2).alias("object"), (F.col("label") % 2 == 1).alias("is_apex"), spatial.twist(F.col("p"), F.col("q"), vec.vec(0, 0, 0), vec.vec(0, 0, 1)).alias("twist"))
    return agg.torsion(turned, ["object"], 80.0).select("object", F.round("twist", 4).alias("twist"), F.round("torsion", 6).alias("torsion"))


@query("strain_by_region", POINTS + """SELECT label, round(avg(0.5 * (px * px + qx * qx + rx * rx - 1)), 6) AS e_xx, round(avg(0.5 * (px * py + qx * qy + rx * ry)), 6) AS e_xy, round(avg(0.5 * (pz * pz + qz * qz + rz * rz - 1)), 6) AS e_zz FROM e GROUP BY 1""")
def _(spark, d):
    tensor = mesh.green_lagrange(F.col("p"), F.col("q"), F.col("r"))
    named = {f"e_{i}{j}": tensor[a][b] for a, i in enumerate("xyz") for b, j in enumerate("xyz") if a <= b}
    means = agg.mean_by_region(points(spark, d), ["label"], named)
    return means.select("label", *(F.round(c, 6).alias(c) for c in ("e_xx", "e_xy", "e_zz")))


@query("center_local", POINTS + ", b AS (SELECT label, (min(px) + max(px)) / 2 AS cx, (min(pz) + max(pz)) / 2 AS cz FROM e GROUP BY 1) SELECT vec_id, round(px - cx, 6) AS x, round(pz - cz, 6) AS z FROM e JOIN b USING (label)")
def _(spark, d):
    moved = agg.centered(points(spark, d), ["label"], "p")
    return out(moved, x=F.col("p.x"), z=F.col("p.z"))


@query("coloration", """WITH v AS (SELECT p_partkey, sqrt(p_retailprice * p_retailprice + p_size * p_size) AS v FROM part), m AS (SELECT min(v) AS a, max(v) AS b FROM v)
SELECT p_partkey, round(CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE greatest(0, least(1, (v - (a - 0.01 * (b - a))) / (b - (a - 0.01 * (b - a))))) END, 6) AS unit, round(1 - CASE WHEN p_partkey % 10 = 0 THEN 0 ELSE greatest(0, least(1, (v - (a - 0.01 * (b - a))) / (b - (a - 0.01 * (b - a))))) END, 6) AS alpha FROM v, m""")
def _(spark, d):
    value = scalars.VALUE_FUNCTIONS["magnitude"](F.array("p_retailprice", F.col("p_size").cast("double")))
    part = table(spark, d, "part").withColumn("value", value)
    found = agg.unit_scaled(part, "value", F.col("p_partkey") % 10 == 0)
    return found.select("p_partkey", F.round("unit", 6).alias("unit"), F.round(scalars.UNIT_FUNCTIONS["inverse"](F.col("unit")), 6).alias("alpha"))
