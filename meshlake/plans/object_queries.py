"""Measures of regions over time, retiming, datasets by name, and basis functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import basis, vec
from ..operators import agg, measures, mesh, timeseries
from .geometry_queries import LATTICE, POINTS, part_lattice, points
from .measure_queries import EXTREMA
from .registry import query, table
from .time_queries import SECONDS, events


def moving_nodes(spark, d):
    """Users as nodes, their group as region, days as time, and the day's mean value, hour and count as the place."""
    e = table(spark, d, "events")
    day = e.groupBy((F.col("user_id") % 3).alias("region"), F.col("user_id").alias("node_id"), F.dayofmonth("ts").alias("step")).agg(F.avg("value").alias("x"), F.avg(F.hour("ts")).alias("y"), F.count("*").cast("double").alias("z"))
    return day.select("region", "node_id", "step", vec.vec(F.col("x"), F.col("y"), F.col("z")).alias("p"))


@query("region_displacement", """WITH n AS (SELECT user_id % 3 AS region, user_id AS node, dayofmonth(ts) AS step, avg(value) AS x, avg(hour(ts)) AS y, count(*)::DOUBLE AS z FROM events GROUP BY 1, 2, 3),
m AS (SELECT *, sqrt((x - first_value(x) OVER w) ** 2 + (y - first_value(y) OVER w) ** 2 + (z - first_value(z) OVER w) ** 2) AS d FROM n WINDOW w AS (PARTITION BY region, node ORDER BY step)),
s AS (SELECT region, step, avg(d) AS a, coalesce(stddev_samp(d), 0) AS s FROM m GROUP BY 1, 2)
SELECT region, step::INT AS step, round(avg(d), 4) AS mean, count(*) AS n_kept FROM m JOIN s USING (region, step) WHERE abs(d - a) <= 1.5 * s + 1e-9 GROUP BY 1, 2""")
def _(spark, d):
    found = measures.displacements(moving_nodes(spark, d), "step", ["region"], 1.5)
    return found.select("region", "step", F.round("trimmed_mean", 4).alias("mean"), "n_kept")


@query("region_thickness", """WITH h AS (SELECT l_returnflag AS region, l_orderkey AS tri, min(l_extendedprice) AS d FROM lineitem GROUP BY 1, 2), s AS (SELECT region, avg(d) AS a, stddev_samp(d) AS s FROM h GROUP BY 1)
SELECT region, round(avg(d), 4) AS mean, count(*) AS n_kept FROM h JOIN s USING (region) WHERE abs(d - a) <= s GROUP BY 1""")
def _(spark, d):
    hits = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("region"), F.col("l_orderkey").alias("tri"), F.col("l_extendedprice").alias("distance"))
    found = measures.wall_thickness(hits, ["region"], "tri", "distance")
    return found.select("region", F.round("trimmed_mean", 4).alias("mean"), "n_kept")


@query("thickness_percent", "WITH y AS (SELECT l_returnflag AS k, year(l_shipdate) AS y, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), p AS (SELECT k, 100 * v / first_value(v) OVER (PARTITION BY k ORDER BY y) AS p FROM y) SELECT k, round(min(p), 4) AS least, round(max(p), 4) AS most FROM p GROUP BY 1")
def _(spark, d):
    yearly = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("k"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("v"))
    return measures.percent_range(yearly, "k", "y", "v").select("k", F.round("least", 4).alias("least"), F.round("most", 4).alias("most"))


@query("torsion_maximum", f"""WITH e AS (SELECT user_id, floor(value) AS v, {SECONDS} AS t FROM events) SELECT user_id, max(v)::DOUBLE AS value, round(max(t) FILTER (v = m), 3) AS "at" FROM (SELECT *, max(v) OVER (PARTITION BY user_id) AS m FROM e) GROUP BY 1""")
def _(spark, d):
    e = events(spark, d).withColumn("value", F.floor("value").cast("double"))
    return measures.latest_maximum(e, ["user_id"], "t", "value").withColumn("at", F.round("at", 3))


@query("line_lengths", f"WITH k AS (SELECT user_id, value AS x, hour(ts)::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) SELECT user_id, round(sqrt((max(x) FILTER (k = 1) - max(x) FILTER (k = 2)) ** 2 + (max(y) FILTER (k = 1) - max(y) FILTER (k = 2)) ** 2), 6) AS length FROM k GROUP BY 1")
def _(spark, d):
    pts = table(spark, d, "events").select("user_id", F.col("event_id").alias("at"), vec.vec(F.col("value"), F.hour("ts").cast("double"), 0.0).alias("p"))
    return measures.line_lengths(pts, ["user_id"]).select("user_id", F.round("length", 6).alias("length"))


_BINS = "WITH h AS (SELECT b AS bin, count(p_partkey) AS n FROM range(0, 51) t(b) LEFT JOIN part ON p_size = b GROUP BY 1), s AS (SELECT a.bin, sum(c.n * exp(-((a.bin - c.bin) ** 2) / 18.0)) / sum(exp(-((a.bin - c.bin) ** 2) / 18.0)) AS v FROM h a JOIN h c ON abs(a.bin - c.bin) <= 12 GROUP BY 1) "


@query("histogram_smooth", _BINS + "SELECT bin, round(v, 6) AS smooth FROM s")
def _(spark, d):
    bins = agg.histogram(table(spark, d, "part").select(F.col("p_size").alias("v")), "v", 0, 51)
    return measures.smoothed(bins, "bin", "n", 3.0).select("bin", F.round("smooth", 6).alias("smooth"))


@query("histogram_is_ct", "WITH h AS (SELECT b AS bin, count(p_partkey) AS n FROM range(0, 51) t(b) LEFT JOIN part ON p_size = b GROUP BY 1)" + EXTREMA.format(last=50, twice=102) + "SELECT count(*) > 3 AS is_ct FROM y WHERE kind = 'max'")
def _(spark, d):
    return measures.is_ct(agg.histogram(table(spark, d, "part").select(F.col("p_size").alias("v")), "v", 0, 51))


def catalogue(spark, d):
    """Nations as spatial index sets of their region's dataset; some have companions."""
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("dataset"), "n_name", "n_nationkey")
    rows = n.select("dataset", F.col("n_name").alias("name"), F.lit("spatial").alias("kind"))
    more = lambda k, suffix: n.where(F.col("n_nationkey") % k == 0).select("dataset", F.concat("n_name", F.lit(suffix)).alias("name"), F.lit("companion").alias("kind"))
    return rows.unionByName(more(2, "_External")).unionByName(more(3, "_AdjInds"))


@query("index_companions", "SELECT n_regionkey AS dataset, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN n_name || '_External' END AS external, CASE WHEN n_nationkey % 3 = 0 THEN n_name || '_AdjInds' END AS adjacency FROM nation")
def _(spark, d):
    return measures.companions(catalogue(spark, d), {"external": "_External", "adjacency": "_AdjInds"})


@query("field_topologies", """SELECT c_custkey AS field, n.n_name AS spatial, coalesce(CASE WHEN c_custkey % 3 = 0 THEN m.n_name END, n.n_name) AS topology FROM customer JOIN nation n ON n.n_nationkey = c_nationkey JOIN nation m ON m.n_nationkey = c_custkey % 25 WHERE c_custkey % 3 <> 0 OR m.n_regionkey = n.n_regionkey""")
def _(spark, d):
    n = table(spark, d, "nation")
    names = n.select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("other"))
    home = n.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("spatial"), F.col("n_regionkey").alias("dataset"))
    fields = table(spark, d, "customer").join(home, "c_nationkey").withColumn("k", F.col("c_custkey") % 25).join(names, "k")
    fields = fields.select("dataset", F.col("c_custkey").alias("field"), "spatial", F.when(F.col("c_custkey") % 3 == 0, F.col("other")).alias("topology"))
    return measures.field_topologies(fields, catalogue(spark, d)).select("field", "spatial", "topology")


@query("spatial_test", "SELECT p_partkey, p_size > 1 AND p_brand LIKE '%1' AS is_spatial, p_size > 1 AND p_brand LIKE '%1' AND p_size % 3 + 1 = 3 AS is_solid FROM part")
def _(spark, d):
    kind, width, dims = F.when(F.col("p_brand").endswith("1"), "spatial").otherwise("field"), F.col("p_size"), F.col("p_size") % 3 + 1
    return table(spark, d, "part").select("p_partkey", measures.is_spatial(kind, width, dims).alias("is_spatial"), measures.is_spatial(kind, width, dims, 3).alias("is_solid"))


@query("field_list", f"SELECT user_id AS dataset, count(*) AS n_fields, list_sort(list(DISTINCT event_type)) AS names, round(min({SECONDS}), 3) AS first_ts, round(max({SECONDS}), 3) AS last_ts FROM events GROUP BY 1")
def _(spark, d):
    fields = events(spark, d).select(F.col("user_id").alias("dataset"), F.col("event_type").alias("name"), F.round("t", 3).alias("ts"))
    return measures.field_list(fields)


@query("extract_steps", f"""WITH e AS (SELECT user_id, event_id, {SECONDS} AS t FROM events), m AS (SELECT * FROM (VALUES (1704100000.0::DOUBLE), (1704500000.0), (1705000000.0)) v(w))
SELECT user_id, w AS step_time, round(t, 3) AS nearest_time, event_id AS nearest_id FROM e, m QUALIFY row_number() OVER (PARTITION BY user_id, w ORDER BY abs(t - w), event_id) = 1""")
def _(spark, d):
    found = timeseries.extract_steps(events(spark, d), ["user_id"], "t", "event_id", [1704100000.0, 1704500000.0, 1705000000.0])
    return found.withColumn("nearest_time", F.round("nearest_time", 3))


@query("retime", f"SELECT event_id, 5 + 0.25 * (row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) - 1)::DOUBLE AS new_time FROM events")
def _(spark, d):
    return timeseries.retime(events(spark, d), ["user_id"], "t", "event_id", 5.0, 0.25).select("event_id", "new_time")


@query("add_step", f"WITH a AS (SELECT user_id, {SECONDS} AS t, value FROM events UNION ALL SELECT DISTINCT user_id, 1704500000.0, -1.0 FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, value) - 1 AS step, round(value, 6) AS value FROM a")
def _(spark, d):
    from ..operators.stored import numbered

    more = timeseries.add_step(events(spark, d), ["user_id"], "t", 1704500000.0, "value", -1.0)
    return numbered(more, ["user_id"], ["t", "value"], "step").select("user_id", "step", F.round("value", 6).alias("value"))


@query("fill_update_steps", f"""WITH e AS (SELECT user_id, event_id, value, {SECONDS} AS t FROM events)
SELECT event_id, round(first_value(value) OVER (PARTITION BY user_id ORDER BY t, event_id), 6) AS filled, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY abs(t - 1704500000.0), event_id) = 1 THEN -1.0 ELSE round(value, 6) END AS updated FROM e""")
def _(spark, d):
    e = events(spark, d)
    filled = timeseries.fill_from_first(e, ["user_id"], "t", "event_id", "value").select("event_id", F.round("value", 6).alias("filled"))
    updated = timeseries.update_nearest(e, ["user_id"], "t", "event_id", 1704500000.0, "value", -1.0).select("event_id", F.round("value", 6).alias("updated"))
    return filled.join(updated, "event_id")


@query("orient_map", f"SELECT user_id % 4 AS obj, round(value, 0) AS angle, list(event_id ORDER BY {SECONDS}, event_id) AS ids, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d).select((F.col("user_id") % 4).alias("obj"), F.col("value").alias("angle"), "t", "event_id")
    return timeseries.oriented_groups(e, ["obj"], ["angle"], "t", "event_id", 0)


@query("first_or_default", f"SELECT user_id, round(coalesce(arg_min(value, (event_id)) FILTER (event_type = 'click'), -1), 6) AS first_value, round(coalesce(arg_max(value, (event_id)) FILTER (event_type = 'click'), -1), 6) AS last_value FROM events GROUP BY 1")
def _(spark, d):
    e = events(spark, d).withColumn("value", F.when(F.col("event_type") == "click", F.col("value")))
    return timeseries.first_or(e, ["user_id"], ["event_id"], "value", -1.0).select("user_id", F.round("first_value", 6).alias("first_value"), F.round("last_value", 6).alias("last_value"))


@query("control_curve", """WITH e AS (SELECT event_id, value AS v, (value - 20) / 40 AS t FROM events)
SELECT event_id, round(CASE WHEN v <= 0 THEN 0 WHEN v <= 20 THEN v / 20 * 0.9 WHEN v <= 60 THEN 0.9 - 0.5 * t WHEN v <= 100 THEN 0.4 + (v - 60) / 40 * 0.6 ELSE 1 END, 6) AS linear,
round(CASE WHEN v > 20 AND v <= 60 THEN 0.5 * (0 * (2 * t ** 2 - t - t ** 3) + 0.9 * (3 * t ** 3 - 5 * t ** 2 + 2) + 0.4 * (4 * t ** 2 + t - 3 * t ** 3) + 1.0 * (t ** 3 - t ** 2)) END, 6) AS middle FROM e""")
def _(spark, d):
    xs, ys = [0.0, 20.0, 60.0, 100.0], [0.0, 0.9, 0.4, 1.0]
    v = F.col("value")
    middle = F.when((v > 20) & (v <= 60), timeseries.control_curve(v, xs, ys))
    return table(spark, d, "events").select("event_id", F.round(timeseries.control_curve(v, xs, ys, True), 6).alias("linear"), F.round(middle, 6).alias("middle"))


@query("basis_lines", """WITH u AS (SELECT event_id, value - floor(value) AS t, 2 * (value - floor(value)) - 1 AS x FROM events)
SELECT event_id, round((1 - x) / 2, 8) AS modal_0, round((1 - x) * (1 + x) / 4 * (15 * x * x - 3) / 4, 8) AS modal_4, round((1 - t) * (1 - 2 * t), 8) AS spectral_0, round((1 - t) * (1 - t), 8) AS spline_0,
round((1 - t) * (1 - t) / ((1 - t) * (1 - t) + 2 * 2 * t * (1 - t) + t * t), 8) AS nurbs_0, round(t * 0.5, 8) AS quad_1, round(0.75 - t, 8) AS tet_0 FROM u""")
def _(spark, d):
    t = F.col("value") - F.floor("value")
    spline = basis.b_spline(t, [0, 0, 0, 1, 1, 1], 2)
    cols = {
        "modal_0": basis.modal_line(t, 4)[0], "modal_4": basis.modal_line(t, 4)[4], "spectral_0": basis.spectral_line(t, 2)[0], "spline_0": spline[0],
        "nurbs_0": basis.rational([1, 2, 1], spline)[0], "quad_1": basis.tensor([1.0 - t, t], [F.lit(0.5), F.lit(0.5)])[1], "tet_0": basis.lagrange("Tet1NL", [t, F.lit(0.25), F.lit(0.0)])[0],
    }
    return table(spark, d, "events").select("event_id", *(F.round(c, 8).alias(k) for k, c in cols.items()))


@query("basis_catmull_grid", """WITH u AS (SELECT event_id, (value - floor(value)) AS u, least(floor((value - floor(value)) * 3), 2) AS p FROM events), k AS (SELECT event_id, p, u * 3 - p AS t FROM u)
SELECT event_id, round(CASE p WHEN 0 THEN 0.5 * ((2 * t ** 2 - t - t ** 3) + (3 * t ** 3 - 5 * t ** 2 + 2)) WHEN 1 THEN 0.5 * (2 * t ** 2 - t - t ** 3) ELSE 0 END, 8) AS w0, round(CASE p WHEN 0 THEN 0.5 * (t ** 3 - t ** 2) WHEN 1 THEN 0.5 * (4 * t ** 2 + t - 3 * t ** 3) ELSE 0.5 * (3 * t ** 3 - 5 * t ** 2 + 2) END, 8) AS w2 FROM k""")
def _(spark, d):
    w = basis.piecewise_catmull_rom(F.col("value") - F.floor("value"), 4)
    return table(spark, d, "events").select("event_id", F.round(w[0], 8).alias("w0"), F.round(w[2], 8).alias("w2"))


@query("basis_faces", LATTICE + """SELECT id AS elem_id, f::INT AS face, list_transform(s, lambda k: id + k % 2 + k // 2 % 2 * 10 + k // 4 * 100) AS nodes FROM e, (VALUES (0, [0::BIGINT, 2, 4, 6]), (1, [0, 1, 4, 5]), (2, [0, 1, 2, 3]), (3, [1, 3, 5, 7]), (4, [2, 3, 6, 7]), (5, [4, 5, 6, 7])) v(f, s)""")
def _(spark, d):
    """The nodes of every side of hexahedra, by the places of the basis."""
    _, elements = part_lattice(spark, d)
    sides = F.array(*(F.array(*(F.get("node_ids", k) for k in side)) for side in basis.face_nodes("Hex", 1)))
    return elements.select("elem_id", F.posexplode(sides).alias("face", "nodes"))


@query("wave_color", "SELECT event_id, round(CASE WHEN v <= 60 THEN 1 - v / 60 WHEN v <= 130 THEN 0 WHEN v <= 200 THEN (v - 130) / 70 ELSE 1 END, 6) AS r, round(CASE WHEN v <= 60 THEN 0 WHEN v <= 110 THEN (v - 60) / 50 WHEN v <= 200 THEN 1 WHEN v <= 265 THEN 1 - (v - 200) / 65 ELSE 0 END, 6) AS g, round(CASE WHEN v <= 110 THEN 1 WHEN v <= 130 THEN 1 - (v - 110) / 20 ELSE 0 END, 6) AS b FROM (SELECT event_id, (value - floor(value)) * 400 AS v FROM events)")
def _(spark, d):
    c = basis.wave_color(F.col("value") - F.floor("value"))
    return table(spark, d, "events").select("event_id", *(F.round(c[k], 6).alias(k) for k in "rgb"))


@query("hermite_matrices", """WITH h AS (SELECT vec_id, i, embedding[i]::DOUBLE AS a, embedding[i + 16]::DOUBLE AS b, embedding[i + 32]::DOUBLE AS s, embedding[i + 48]::DOUBLE AS e FROM embeddings, range(1, 17) t(i))
SELECT vec_id AS row_id, list(round(0.84375 * a + 0.15625 * b + 0.140625 * s - 0.046875 * e, 6) ORDER BY i) AS vals FROM h GROUP BY 1""")
def _(spark, d):
    from .matrix_queries import embedding_matrix, rounded

    part = lambda k: embedding_matrix(spark, d).withColumn("vals", F.slice("vals", 16 * k + 1, 16))
    return rounded(mesh.hermite_matrices(part(0), part(1), part(2), part(3), 0.25))


@query("mesh_representation", LATTICE + """, s AS (SELECT id, f::INT AS face, id + CASE f WHEN 1 THEN 100 WHEN 3 THEN 10 WHEN 5 THEN 1 ELSE 0 END AS place, f // 2 AS axis FROM e, range(0, 6) t(f))
SELECT any_value(id) AS elem_id, any_value(face) AS face, 2::BIGINT AS n FROM s GROUP BY place, axis HAVING count(*) = 1""")
def _(spark, d):
    """The triangles of the outer faces of the parts' lattice."""
    _, elements = part_lattice(spark, d)
    return mesh.representation(elements, "Hex").groupBy("elem_id", "face").agg(F.count("*").alias("n"))


@query("grid_triangles", LATTICE + """, t AS (SELECT id, f::INT AS face, c FROM e, (VALUES (0, [0, 1, 10, 11]), (1, [100, 101, 110, 111]), (2, [0, 1, 100, 101]), (3, [10, 11, 110, 111]), (4, [0, 10, 100, 110]), (5, [1, 11, 101, 111])) v(f, c))
SELECT id AS elem_id, face, p::INT AS part, CASE p WHEN 0 THEN [id + c[1], id + c[2], id + c[3]] ELSE [id + c[2], id + c[4], id + c[3]] END AS node_ids FROM t, range(0, 2) u(p)""")
def _(spark, d):
    _, elements = part_lattice(spark, d)
    return mesh.triangulate(elements, "Hex").select("elem_id", "face", "part", "node_ids")


@query("grid_nodes", LATTICE + "SELECT id AS elem_id, k::INT AS k, x + k % 3 / 2.0::DOUBLE AS x, y + k // 3 % 3 / 2.0::DOUBLE AS y, z + k // 9 / 2.0::DOUBLE AS z FROM e, range(0, 27) t(k)")
def _(spark, d):
    """The points of hexahedra refined once: corners, middles of edges and faces, and the center."""
    nodes, elements = part_lattice(spark, d)
    found = mesh.positions(elements, nodes.select("node_id", "p"), "Hex1NL", mesh.xi_template("Hex", 1))
    return found.select("elem_id", "k", *(F.round(f"p.{c}", 6).alias(c) for c in "xyz"))


@query("element_points", LATTICE + "SELECT id AS elem_id, k::INT AS k, x + 0.25 + 0.5 * k::DOUBLE AS x, y + 0.5::DOUBLE AS y FROM e, range(0, 2) t(k)")
def _(spark, d):
    nodes, elements = part_lattice(spark, d)
    found = mesh.positions(elements, nodes.select("node_id", "p"), "Hex1NL", [(0.25, 0.5, 0.5), (0.75, 0.5, 0.5)])
    return found.select("elem_id", "k", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("plane_cut_edges", LATTICE + "SELECT id AS elem_id, 4::BIGINT AS n, 4.25::DOUBLE AS x FROM e WHERE x = 4")
def _(spark, d):
    nodes, elements = part_lattice(spark, d)
    cut = mesh.slice_plane(elements, nodes.select("node_id", "p"), (4.25, 0.0, 0.0), (1.0, 0.0, 0.0), "Hex")
    return cut.groupBy("elem_id").agg(F.count("*").alias("n"), F.round(F.max("p.x"), 9).alias("x"))


@query("vertex_normals", POINTS + """, t AS (SELECT vec_id, (vec_id * 3 + k) % 50 AS node, k FROM e, range(0, 3) t(k)), c AS (SELECT vec_id, px AS ax, py AS ay, pz AS az, qx AS bx, qy AS by_, qz AS bz, rx AS cx, ry AS cy, rz AS cz FROM e),
n AS (SELECT vec_id, (by_ - ay) * (cz - az) - (bz - az) * (cy - ay) AS x, (bz - az) * (cx - ax) - (bx - ax) * (cz - az) AS y, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS z FROM c), u AS (SELECT vec_id, x / sqrt(x * x + y * y + z * z) AS x, y / sqrt(x * x + y * y + z * z) AS y, z / sqrt(x * x + y * y + z * z) AS z FROM n),
s AS (SELECT node, sum(x) AS x, sum(y) AS y, sum(z) AS z FROM t JOIN u USING (vec_id) GROUP BY 1) SELECT node AS node_id, round(x / sqrt(x * x + y * y + z * z), 6) AS x, round(z / sqrt(x * x + y * y + z * z), 6) AS z FROM s""")
def _(spark, d):
    from ..operators import spatial

    ids = F.array(*((F.col("vec_id") * 3 + k) % 50 for k in range(3)))
    triangles = points(spark, d).select(ids.alias("node_ids"), F.col("p").alias("a"), F.col("q").alias("b"), F.col("r").alias("c"))
    return spatial.vertex_normals(triangles).select("node_id", F.round("normal.x", 6).alias("x"), F.round("normal.z", 6).alias("z"))


@query("closest_power", "SELECT event_id, CASE WHEN value <> 0 THEN floor(log10(abs(value))) + (abs(value) >= 5.5 * power(10, floor(log10(abs(value)))))::INT END::BIGINT AS power FROM events")
def _(spark, d):
    from ..functions import scalars

    return table(spark, d, "events").select("event_id", scalars.closest_power(F.col("value")).cast("bigint").alias("power"))
