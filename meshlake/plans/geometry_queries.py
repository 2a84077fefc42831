"""Vectors, selection, adjacency and mesh formulas, over embeddings as points and orders as elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import basis, vec
from ..operators import agg, mesh, spatial
from .registry import query, table

#: SQL for four points p, q, r and s in twelve dimensions of an embedding, from each fourth one on, around the end: sixteen rows a vector.
POINTS = "WITH e AS (SELECT vec_id * 16 + g AS vec_id, label, " + ", ".join(f"embedding[(4 * g + {3 * k + j}) % 64 + 1]::DOUBLE AS {n}{c}" for k, n in enumerate("pqrs") for j, c in enumerate("xyz")) + " FROM embeddings, range(0, 16) t(g)) "


def points(spark, d):
    """(vec_id, label, p, q, r, s): the points are made as they are exploded, so that formulas over them do not repeat how."""
    value = lambda g, k: F.get("embedding", (g * 4 + k) % 64).cast("double")
    group = lambda g: F.struct(g.alias("g"), *(vec.vec(*(value(g, 3 * k + j) for j in range(3))).alias(n) for k, n in enumerate("pqrs")))
    e = table(spark, d, "embeddings").select("vec_id", "label", F.explode(F.transform(F.sequence(F.lit(0), F.lit(15)), group)).alias("x"))
    return e.select((F.col("vec_id") * 16 + F.col("x.g")).alias("vec_id"), "label", *(F.col(f"x.{n}").alias(n) for n in "pqrs"))


#: SQL for parts as nodes of a lattice of 10 × 10 in layers, and its hexahedra.
LATTICE = """WITH n AS (SELECT p_partkey AS id, p_partkey % 10 AS x, p_partkey // 10 % 10 AS y, p_partkey // 100 AS z, p_retailprice AS val, p_size::DOUBLE AS size FROM part),
e AS (SELECT a.id, a.x, a.y, a.z FROM n a WHERE a.x < 9 AND a.y < 9 AND (SELECT count(*) FROM n b WHERE b.id IN (a.id + 1, a.id + 10, a.id + 11, a.id + 100, a.id + 101, a.id + 110, a.id + 111)) = 7) """


def part_lattice(spark, d):
    """(nodes, elements): parts by their number on a lattice of 10 × 10 in layers, and the hexahedra whose eight corners are there."""
    key = F.col("p_partkey").cast("bigint")
    at = vec.vec((key % 10).cast("double"), (F.floor(key / 10) % 10).cast("double"), F.floor(key / 100).cast("double"))
    nodes = table(spark, d, "part").select(key.alias("node_id"), at.alias("p"), F.col("p_retailprice").alias("val"), F.col("p_size").cast("double").alias("size"))
    steps = [a + 10 * b + 100 * c for c in (0, 1) for b in (0, 1) for a in (0, 1)]
    firsts = nodes.where("p.x < 9 and p.y < 9").select(F.col("node_id").alias("elem_id"), F.array(*(F.col("node_id") + s for s in steps)).alias("node_ids"))
    whole = firsts.select("elem_id", F.explode("node_ids").alias("node_id")).join(nodes.select("node_id"), "node_id").groupBy("elem_id").agg(F.count("*").alias("n")).where("n = 8")
    return nodes, firsts.join(whole.select("elem_id"), "elem_id", "left_semi")


def out(df, **cols):
    return df.select("vec_id", *(F.round(c, 6).alias(k) for k, c in cols.items()))


@query("vec_algebra", POINTS + """SELECT vec_id, round(px * qx + py * qy + pz * qz, 6) AS dot, round(py * qz - pz * qy, 6) AS cross_x, round(pz * qx - px * qz, 6) AS cross_y, round(px * qy - py * qx, 6) AS cross_z,
round(sqrt(px * px + py * py + pz * pz), 6) AS length, round(sqrt((px - qx) ** 2 + (py - qy) ** 2 + (pz - qz) ** 2), 6) AS distance, round(px / sqrt(px * px + py * py + pz * pz), 6) AS norm_x FROM e""")
def _(spark, d):
    c = vec.cross(F.col("p"), F.col("q"))
    return out(points(spark, d), dot=vec.dot(F.col("p"), F.col("q")), cross_x=c["x"], cross_y=c["y"], cross_z=c["z"], length=vec.length(F.col("p")), distance=vec.distance(F.col("p"), F.col("q")), norm_x=vec.norm(F.col("p"))["x"])


@query("vec_angle", POINTS + "SELECT vec_id, round(acos((px * qx + py * qy + pz * qz) / (sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz))), 6) AS angle FROM e")
def _(spark, d):
    return out(points(spark, d), angle=vec.angle(F.col("p"), F.col("q")))


@query("polar_cylindrical", POINTS + "SELECT vec_id, round(atan2(py, px), 6) AS theta, round(acos(pz / sqrt(px * px + py * py + pz * pz)), 6) AS phi, round(sqrt(px * px + py * py), 6) AS radius, round(px, 6) AS back_x FROM e")
def _(spark, d):
    t = vec.polar(F.col("p"))
    return out(points(spark, d), theta=t["x"], phi=t["y"], radius=vec.cylindrical(F.col("p"))["z"], back_x=vec.from_polar(t)["x"])


@query("plane_distance", POINTS + "SELECT vec_id, round((px + py + pz) / sqrt(3) - 0.01, 6) AS d, round(px - ((px + py + pz) / sqrt(3) - 0.01) / sqrt(3), 6) AS projected_x FROM e")
def _(spark, d):
    n = vec.vec(*[3**-0.5] * 3)
    at = vec.vec(*[0.01 * 3**-0.5] * 3)
    return out(points(spark, d), d=vec.plane_distance(F.col("p"), at, n), projected_x=vec.plane_project(F.col("p"), at, n)["x"])


@query("in_shapes", POINTS + "SELECT vec_id, px > 0 - 1e-10 AND px < 1 + 1e-10 AND py > 0 - 1e-10 AND py < 1 + 1e-10 AND pz > 0 - 1e-10 AND pz < 1 + 1e-10 AS in_box, px * px + py * py + pz * pz <= 0.04 + 1e-10 AS in_sphere FROM e")
def _(spark, d):
    return points(spark, d).select("vec_id", vec.in_box(F.col("p"), vec.vec(0, 0, 0), vec.vec(1, 1, 1)).alias("in_box"), vec.in_sphere(F.col("p"), vec.vec(0, 0, 0), 0.2).alias("in_sphere"))


@query("tri_area_normal", POINTS + """, n AS (SELECT *, (qy - py) * (rz - pz) - (qz - pz) * (ry - py) AS nx, (qz - pz) * (rx - px) - (qx - px) * (rz - pz) AS ny, (qx - px) * (ry - py) - (qy - py) * (rx - px) AS nz FROM e)
SELECT vec_id, round(sqrt(nx * nx + ny * ny + nz * nz) / 2, 6) AS area, round(nz / sqrt(nx * nx + ny * ny + nz * nz), 6) AS normal_z FROM n""")
def _(spark, d):
    return out(points(spark, d), area=vec.triangle_area(F.col("p"), F.col("q"), F.col("r")), normal_z=vec.triangle_normal(F.col("p"), F.col("q"), F.col("r"))["z"])


@query("tet_volume", POINTS + """SELECT vec_id, round(abs((px - sx) * ((qy - sy) * (rz - sz) - (qz - sz) * (ry - sy)) + (py - sy) * ((qz - sz) * (rx - sx) - (qx - sx) * (rz - sz)) + (pz - sz) * ((qx - sx) * (ry - sy) - (qy - sy) * (rx - sx))) / 6, 6) AS volume FROM e""")
def _(spark, d):
    return out(points(spark, d), volume=vec.tet_volume(F.col("p"), F.col("q"), F.col("r"), F.col("s")))


@query("segment_distance", POINTS + """, t AS (SELECT *, ((px - qx) * (rx - qx) + (py - qy) * (ry - qy) + (pz - qz) * (rz - qz)) / ((rx - qx) ** 2 + (ry - qy) ** 2 + (rz - qz) ** 2) AS t FROM e)
SELECT vec_id, round(CASE WHEN t < 0 OR t > 1 THEN -1 ELSE sqrt((px - qx - t * (rx - qx)) ** 2 + (py - qy - t * (ry - qy)) ** 2 + (pz - qz - t * (rz - qz)) ** 2) END, 6) AS d FROM t""")
def _(spark, d):
    return out(points(spark, d), d=vec.segment_distance(F.col("p"), F.col("q"), F.col("r")))


@query("rotate_transform", POINTS + "SELECT vec_id, round(-2 * py + 1, 6) AS x, round(2 * px, 6) AS y, round(2 * pz - 3, 6) AS z, round(px, 6) AS back_x FROM e")
def _(spark, d):
    import math

    how = (1, 0, -3), (2, 2, 2), (0, 0, 1), math.pi / 2
    moved = points(spark, d).withColumn("m", vec.affine(F.col("p"), vec.affine_numbers(*how)))
    back = vec.affine(F.col("m"), vec.affine_numbers(*how, inverse=True))
    return out(moved, x=F.col("m.x"), y=F.col("m.y"), z=F.col("m.z"), back_x=back["x"])


@query("color_pack", "SELECT event_id, (floor((value - floor(value)) * 255) * 16777216 + 127 * 65536 + 0 * 256 + 255)::BIGINT AS rgba FROM events")
def _(spark, d):
    v = F.col("value") - F.floor("value")
    return table(spark, d, "events").select("event_id", vec.pack_color(v, 0.5, 0.0, 1.0).cast("bigint").alias("rgba"))


@query("ray_sphere", POINTS + """, h AS (SELECT vec_id, pz AS along, 0.04 - (px * px + py * py) AS rest FROM e)
SELECT vec_id, round(along - sqrt(rest), 6) AS near, round(along + sqrt(rest), 6) AS far FROM h WHERE rest >= 0""")
def _(spark, d):
    t = points(spark, d).withColumn("t", vec.ray_sphere(vec.vec(0, 0, 0), vec.vec(0, 0, 1), F.col("p"), 0.2)).where("t is not null")
    return out(t, near=F.get("t", 0), far=F.get("t", 1))


@query("aabb_agg", POINTS + "SELECT label, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round((min(y) + max(y)) / 2, 6) AS center_y, round(sqrt(((max(x) - min(x)) / 2) ** 2 + ((max(y) - min(y)) / 2) ** 2 + ((max(z) - min(z)) / 2) ** 2), 6) AS radius FROM (SELECT label, px AS x, py AS y, pz AS z FROM e) GROUP BY 1")
def _(spark, d):
    boxes = agg.aabb(points(spark, d), ["label"], F.col("p"))
    return boxes.select("label", *(F.round(c, 6).alias(c) for c in ("min_x", "max_x", "center_y", "radius")))


LEAF = "(least(7, greatest(0, floor(({c} + 0.5) / 1.0 * 8)))::BIGINT)"
_bits = " + ".join(f"(((({LEAF.format(c='p' + 'xyz'[k])}) >> {b}) & 1) << {3 * b + k})" for b in range(3) for k in range(3))


@query("octree_key", POINTS + f"SELECT vec_id, {_bits} AS leaf FROM e")
def _(spark, d):
    return points(spark, d).select("vec_id", spatial.leaf_key(F.col("p"), (-0.5,) * 3, (0.5,) * 3, 3).alias("leaf"))


@query("octree_csr", POINTS + f"SELECT {_bits} AS leaf, list(vec_id ORDER BY vec_id) AS members, count(*) AS n FROM e GROUP BY 1")
def _(spark, d):
    keyed = points(spark, d).select("vec_id", spatial.leaf_key(F.col("p"), (-0.5,) * 3, (0.5,) * 3, 3).alias("leaf"))
    return keyed.groupBy("leaf").agg(F.array_sort(F.collect_list("vec_id")).alias("members"), F.count("*").alias("n"))


@query("plane_select", POINTS + "SELECT vec_id FROM e WHERE least(px, qx, rx, sx) <= 0.05 AND greatest(px, qx, rx, sx) >= 0.05")
def _(spark, d):
    elements = points(spark, d).withColumn("corners", F.array("p", "q", "r", "s"))
    return spatial.cut_by_plane(elements, "corners", vec.vec(0.05, 0, 0), vec.vec(1, 0, 0)).select("vec_id")


@query("adjacency", """WITH f AS (SELECT l_orderkey AS elem_id, l_linenumber AS face, l_partkey, l_suppkey FROM lineitem)
SELECT a.elem_id, a.face, b.elem_id AS other_elem, b.face AS other_face FROM f a JOIN f b USING (l_partkey, l_suppkey) WHERE a.elem_id <> b.elem_id""")
def _(spark, d):
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem_id"), F.col("l_linenumber").alias("face"), F.array(F.col("l_partkey") * 1000, F.col("l_suppkey").cast("bigint")).alias("node_ids"))
    # Part and supplier numbers must not be mistaken for each other once sorted, so parts are kept apart.
    return spatial.adjacency(faces.withColumn("node_ids", F.array(-F.col("node_ids")[0] - 1, F.col("node_ids")[1])))


@query("external_faces", "SELECT min(l_orderkey) AS elem_id, min(l_linenumber) AS face FROM lineitem GROUP BY l_partkey, l_suppkey HAVING min(l_orderkey) = max(l_orderkey)")
def _(spark, d):
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("elem_id"), F.col("l_linenumber").alias("face"), F.array(-F.col("l_partkey") - 1, F.col("l_suppkey").cast("bigint")).alias("node_ids"))
    return spatial.external(faces)


@query("dedup_nodes", POINTS + "SELECT vec_id AS node_id, min(vec_id) OVER (PARTITION BY round(px, 2), round(py, 2)) AS keep_id FROM e")
def _(spark, d):
    flat = vec.vec(F.col("p.x"), F.col("p.y"), 0)
    return spatial.dedup_nodes(points(spark, d).select(F.col("vec_id").alias("node_id"), flat.alias("p")), 2)


@query("reindex_nodes", """WITH u AS (SELECT l_partkey AS node_id, min(l_orderkey * 100 + l_linenumber) AS f FROM lineitem GROUP BY 1) SELECT node_id, row_number() OVER (ORDER BY f, node_id) - 1 AS new_id FROM u""")
def _(spark, d):
    index = table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("elem_id"), F.array("l_partkey").alias("node_ids"))
    return spatial.reindex(index)


#: SQL for the fans of triangles of `triangles`.
FANS = """WITH o AS (SELECT l_orderkey AS key, list(l_partkey ORDER BY l_linenumber, l_partkey) AS l FROM lineitem GROUP BY 1 HAVING count(*) >= 3),
t AS (SELECT key * 100 + k AS elem_id, [l[1], l[k + 1], l[k + 2]] AS ids FROM (SELECT key, l, unnest(range(1, len(l) - 1)) AS k FROM o)) """


@query("unique_edges", FANS + """, e AS (SELECT ids[1] AS a, ids[2] AS b FROM t UNION ALL SELECT ids[2], ids[3] FROM t UNION ALL SELECT ids[3], ids[1] FROM t) SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM e WHERE a <> b""")
def _(spark, d):
    return mesh.unique_edges(triangles(spark, d)).where("a <> b")


def triangles(spark, d):
    """The parts of every order's lines as a fan of triangles around the first; orders of fewer than three lines have none."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("elem_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda c: c["l_partkey"]).alias("ids"))
    fans = lines.where(F.size("ids") >= 3).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)))
    return fans.select((F.col("elem_id") * 100 + F.col("k")).alias("elem_id"), F.array(F.get("ids", F.lit(0)), F.get("ids", F.col("k")), F.get("ids", F.col("k") + 1)).alias("node_ids"))


@query("iso_edges", FANS + """, e AS (SELECT elem_id, 0 AS edge, ids[1] AS a, ids[2] AS b FROM t UNION ALL SELECT elem_id, 1, ids[2], ids[3] FROM t UNION ALL SELECT elem_id, 2, ids[3], ids[1] FROM t),
v AS (SELECT elem_id, edge, x.p_retailprice AS va, y.p_retailprice AS vb FROM e JOIN part x ON x.p_partkey = a JOIN part y ON y.p_partkey = b)
SELECT elem_id, edge, round((910.05 - va) / (vb - va), 6) AS t FROM v WHERE least(va, vb) <= 910.05 AND greatest(va, vb) >= 910.05 AND va <> vb""")
def _(spark, d):
    values = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("val"))
    return mesh.iso_crossings(triangles(spark, d), values, 910.05).select("elem_id", "edge", F.round("t", 6).alias("t"))


@query("element_values", FANS + """SELECT elem_id, round(0.5 * x.p_retailprice + 0.25 * y.p_retailprice + 0.25 * z.p_retailprice, 4) AS val FROM t JOIN part x ON x.p_partkey = ids[1] JOIN part y ON y.p_partkey = ids[2] JOIN part z ON z.p_partkey = ids[3]""")
def _(spark, d):
    values = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_retailprice").alias("val"))
    return mesh.evaluate(triangles(spark, d), values, "Tri1NL", (0.25, 0.25)).select("elem_id", F.round("val", 4).alias("val"))


@query("basis_functions", """WITH u AS (SELECT event_id, value - floor(value) AS t FROM events)
SELECT event_id, round((1 - t) * (1 - 2 * t), 8) AS line2_0, round(4 * t * (1 - t), 8) AS line2_1, round(3 * t * (1 - t) ** 2, 8) AS bezier_1, round(2 * t ** 3 - 3 * t ** 2 + 1, 8) AS hermite_1, round(0.5 * (3 * t ** 3 - 5 * t ** 2 + 2), 8) AS catmull_1 FROM u""")
def _(spark, d):
    t = F.col("value") - F.floor("value")
    line = basis.lagrange("Line2NL", [t])
    cols = {"line2_0": line[0], "line2_1": line[1], "bezier_1": basis.bezier(t)[1], "hermite_1": basis.hermite(t)[1], "catmull_1": basis.catmull_rom(t)[1]}
    return table(spark, d, "events").select("event_id", *(F.round(c, 8).alias(k) for k, c in cols.items()))


@query("strain_tensor", POINTS + """SELECT vec_id, round(0.5 * (px * px + qx * qx + rx * rx - 1), 6) AS e_xx, round(0.5 * (px * py + qx * qy + rx * ry), 6) AS e_xy, round(0.5 * (pz * pz + qz * qz + rz * rz - 1), 6) AS e_zz FROM e""")
def _(spark, d):
    e = mesh.green_lagrange(F.col("p"), F.col("q"), F.col("r"))
    return out(points(spark, d), e_xx=e[0][0], e_xy=e[0][1], e_zz=e[2][2])


@query("determinant", POINTS + "SELECT vec_id, round(px * (qy * rz - qz * ry) - py * (qx * rz - qz * rx) + pz * (qx * ry - qy * rx), 6) AS det FROM e")
def _(spark, d):
    return out(points(spark, d), det=vec.determinant([[v[c] for c in "xyz"] for v in (F.col("p"), F.col("q"), F.col("r"))]))


@query("points_in_polygon", POINTS + "SELECT vec_id AS id FROM e WHERE abs(px) + abs(py) < 0.15")
def _(spark, d):
    corners = [(0.15, 0.0), (0.0, 0.15), (-0.15, 0.0), (0.0, -0.15)]
    edges = spark.createDataFrame([(0, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1])], "poly int, x1 double, y1 double, x2 double, y2 double")
    pts = points(spark, d).select(F.col("vec_id").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return spatial.points_in_polygon(pts, edges).select("id")


@query("mesh_integrity", """WITH i AS (SELECT CASE WHEN l_orderkey % 97 = 0 THEN [l_partkey, l_suppkey] WHEN l_orderkey % 89 = 0 THEN [l_partkey, NULL, l_suppkey] WHEN l_orderkey % 83 = 0 THEN [l_partkey, -1, l_suppkey] ELSE [l_partkey, l_linenumber, l_suppkey] END AS ids FROM lineitem)
SELECT count(*) FILTER (len(list_filter(ids, lambda v: v < 0 OR v >= 1000)) > 0) AS out_of_range, count(*) FILTER (len(ids) <> 3) AS wrong_width, count(*) FILTER (len(list_filter(ids, lambda v: v IS NULL)) > 0) AS has_null FROM i""")
def _(spark, d):
    """An index with planted faults: rows too short, nulls and negative nodes."""
    a, b, c = F.col("l_partkey"), F.col("l_linenumber").cast("bigint"), F.col("l_suppkey")
    bad = lambda k: F.col("l_orderkey") % k == 0
    ids = F.when(bad(97), F.array(a, c)).when(bad(89), F.array(a, F.lit(None).cast("bigint"), c)).when(bad(83), F.array(a, F.lit(-1).cast("bigint"), c)).otherwise(F.array(a, b, c))
    return agg.check_index(table(spark, d, "lineitem").select(ids.alias("node_ids")), "node_ids", 1000, 3)
