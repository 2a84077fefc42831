"""Image volumes, masks, contours and surfaces, over events as pixels and embeddings as points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vec
from ..operators import images, lines, spatial, volumes
from .geometry_queries import POINTS, out, points
from .image_queries import KEYS, PIXELS, pixels
from .registry import query, table

#: Pixels over 20 as a mask, and a table of all its cells.
MASK = PIXELS + ", m AS (SELECT image_id, row, col FROM p WHERE val > 20) "


def mask(spark, d):
    return pixels(spark, d).where("val > 20").select("image_id", "row", "col")


@query("hounsfield", "SELECT event_id, round(greatest(0, least(1, (value - 10) / 50)), 6)::DOUBLE AS unit FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(volumes.hounsfield_unit(F.col("value"), 10, 60), 6).alias("unit"))


@query("nan_check", "SELECT 'value' AS \"column\", count(*) FILTER (event_id % 100 = 0) AS n FROM events UNION ALL SELECT 'other', 0 FROM (SELECT 1)")
def _(spark, d):
    e = table(spark, d, "events").select(F.when(F.col("event_id") % 100 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.col("value").alias("other"))
    return volumes.nan_counts(e, ["value", "other"])


@query("image_ray", PIXELS + """, k AS (SELECT k, floor(2.2 + k * 1.5 + 0.5)::INT AS row, floor(1.7 + k * 0.9 + 0.5)::INT AS col FROM range(0, 20) t(k)), f AS (SELECT min(k) AS stop FROM k WHERE row > 23 OR col > 15)
SELECT i.image_id, k.k::INT AS k, coalesce(val, 0)::DOUBLE AS val FROM (SELECT DISTINCT image_id FROM p) i, k, f LEFT JOIN p ON p.image_id = i.image_id AND p.row = k.row AND p.col = k.col WHERE k.k < stop""")
def _(spark, d):
    return volumes.sample_ray(pixels(spark, d), KEYS, (2.2, 1.7), (1.5, 0.9), 20, 24, 16)


@query("image_volume_test", """WITH i AS (SELECT label, vec_id, vec_id * 0.5 AS y, CASE WHEN label % 2 = 1 THEN (vec_id // 10) % 7 ELSE 3 END AS z FROM embeddings), a AS (SELECT label, arg_min(y, vec_id) AS y0, arg_min(z, vec_id) AS z0, arg_max(y, vec_id) AS y1, arg_max(z, vec_id) AS z1 FROM i GROUP BY 1)
SELECT label, bool_and(abs((y - y0) * (z1 - z0) - (z - z0) * (y1 - y0)) / sqrt((y1 - y0) ** 2 + (z1 - z0) ** 2) <= 1e-3) AS is_volume FROM i JOIN a USING (label) GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    z = F.when(F.col("label") % 2 == 1, F.floor(F.col("vec_id") / 10) % 7).otherwise(3)
    stack = e.select("label", "vec_id", vec.vec(F.col("label").cast("double"), F.col("vec_id") * 0.5, z.cast("double")).alias("pos"), vec.vec(0, 0, 1).alias("normal"), vec.vec(10, -10, 0).alias("diagonal"))
    return volumes.is_volume(stack, "label", "vec_id")


@query("voxel_depth", "WITH s AS (SELECT DISTINCT user_id, round(value, 1) AS z FROM events), g AS (SELECT user_id, lead(z) OVER (PARTITION BY user_id ORDER BY z) - z AS g FROM s) SELECT user_id, round(coalesce(min(g), 0), 4) AS depth FROM g GROUP BY 1")
def _(spark, d):
    slices = table(spark, d, "events").select("user_id", F.round("value", 1).alias("z"))
    return volumes.voxel_depth(slices, ["user_id"], "z").select("user_id", F.round("depth", 4).alias("depth"))


@query("respaced_grid", PIXELS + "SELECT DISTINCT image_id, r::INT AS row, c::INT AS col, round((r + 0.5) * 1.5 - 0.5, 6)::DOUBLE AS y, round((c + 0.5) * 1.5 - 0.5, 6)::DOUBLE AS x FROM p, range(0, 16) a(r), range(0, 11) b(c)")
def _(spark, d):
    grid = volumes.respaced_grid(pixels(spark, d), KEYS, 24, 16, 1.0, 1.5)
    return grid.select("image_id", "row", "col", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"))


@query("image_shift", PIXELS + "SELECT image_id, row + image_id AS row, col - 2 * image_id AS col, val FROM p WHERE row + image_id < 24 AND col - 2 * image_id >= 0")
def _(spark, d):
    p = pixels(spark, d)
    shifts = p.select("image_id").distinct().withColumns({"dr": F.col("image_id"), "dc": -2 * F.col("image_id")})
    return volumes.shift(p, shifts, KEYS, 24, 16)


@query("merge_images", """WITH a AS (SELECT event_id % 2 AS s, user_id % 4 AS image_id, hour(ts)::INT AS row, (user_id // 4 % 16)::INT AS col, round(sum(value), 4) AS val FROM events GROUP BY ALL),
g AS (SELECT s, i.image_id, r.r AS row, c.c AS col, r.r * 23.0::DOUBLE / 5.0::DOUBLE AS y, c.c * 15.0::DOUBLE / 3.0::DOUBLE AS x FROM (SELECT DISTINCT s, image_id FROM a) i, range(0, 6) r(r), range(0, 4) c(c)),
k AS (SELECT s, image_id, g.row, g.col, floor(y)::BIGINT + dy AS sr, floor(x)::BIGINT + dx AS sc, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)),
v AS (SELECT k.s, k.image_id, k.row, k.col, sum(coalesce(a.val, 0) * w) AS val FROM k LEFT JOIN a ON a.s = k.s AND a.image_id = k.image_id AND a.row = sr AND a.col = sc GROUP BY ALL)
SELECT image_id, row::INT AS row, col::INT AS col, round(max(val), 4) AS val FROM v GROUP BY ALL""")
def _(spark, d):
    e = table(spark, d, "events")
    stack = lambda k: e.where(F.col("event_id") % 2 == k).groupBy((F.col("user_id") % 4).alias("image_id"), F.hour("ts").alias("row"), (F.floor(F.col("user_id") / 4) % 16).cast("int").alias("col")).agg(F.round(F.sum("value"), 4).alias("val"))
    merged = images.merge([images.resample(stack(k), KEYS, 24, 16, 6, 4) for k in (0, 1)], KEYS, "max")
    return merged.withColumn("val", F.round("val", 4))


@query("stack_samples", POINTS + PIXELS.replace("WITH", ",") + """, b AS (SELECT vec_id, px + 0.5 AS x, py + 0.5 AS y, pz + 0.5 AS z FROM e),
k AS (SELECT vec_id, floor(y * 23)::BIGINT + a AS row, floor(x * 15)::BIGINT + b AS col, floor(z * 3)::BIGINT + c AS image_id, abs(1 - a - (y * 23 - floor(y * 23))) * abs(1 - b - (x * 15 - floor(x * 15))) * abs(1 - c - (z * 3 - floor(z * 3))) AS w
FROM b, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b), (VALUES (0), (1)) u(c) WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND z BETWEEN 0 AND 1), v AS (SELECT vec_id, sum(coalesce(val, 0) * w) AS val FROM k LEFT JOIN p USING (row, col, image_id) GROUP BY 1)
SELECT vec_id AS id, round(coalesce(val, 0), 4) AS val FROM b LEFT JOIN v USING (vec_id)""")
def _(spark, d):
    asked = points(spark, d).select(F.col("vec_id").alias("id"), *((F.col(f"p.{c}") + 0.5).alias(c) for c in "xyz"))
    stack = pixels(spark, d).withColumnRenamed("image_id", "slice")
    return volumes.sample_stack(asked, stack, 24, 16, 4).withColumn("val", F.round("val", 4))


@query("bilinear_samples", POINTS + PIXELS.replace("WITH", ",") + """, g AS (SELECT vec_id, px + 0.5 AS x, py + 0.5 AS y FROM e),
k AS (SELECT vec_id, vec_id % 4 AS image_id, floor(y * 23)::BIGINT + a AS row, floor(x * 15)::BIGINT + b AS col, abs(1 - a - (y * 23 - floor(y * 23))) * abs(1 - b - (x * 15 - floor(x * 15))) AS w FROM g, (VALUES (0), (1)) s(a), (VALUES (0), (1)) t(b) WHERE x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1),
v AS (SELECT vec_id, sum(coalesce(val, 0) * w) AS val FROM k LEFT JOIN p USING (image_id, row, col) GROUP BY 1) SELECT vec_id AS id, round(coalesce(val, 0), 4) AS val FROM g LEFT JOIN v USING (vec_id)""")
def _(spark, d):
    asked = points(spark, d).select(F.col("vec_id").alias("id"), (F.col("p.x") + 0.5).alias("x"), (F.col("p.y") + 0.5).alias("y"), ((F.col("vec_id") % 4) / 3.0).alias("z"))
    return volumes.sample_stack(asked, pixels(spark, d).withColumnRenamed("image_id", "slice"), 24, 16, 4).withColumn("val", F.round("val", 4))


@query("dilate_volume", PIXELS + "SELECT a.image_id AS slice, a.row, a.col, a.val, max(b.val) AS dilated FROM p a JOIN p b ON abs(a.image_id - b.image_id) <= 1 AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3, 4")
def _(spark, d):
    return volumes.dilate_volume(pixels(spark, d).withColumnRenamed("image_id", "slice"), [], 1)


_reach = """r AS (SELECT image_id, row, col, row * 1000 + col AS label FROM m UNION SELECT m.image_id, m.row, m.col, r.label FROM r JOIN m ON m.image_id = r.image_id AND abs(m.row - r.row) + abs(m.col - r.col) = 1)"""


@query("mask_objects", MASK.replace("WITH p", "WITH RECURSIVE p") + f", {_reach}, o AS (SELECT image_id, row, col, min(label) AS label FROM r GROUP BY 1, 2, 3) SELECT image_id, label // 1000 AS first_row, label % 1000 AS first_col, count(*) AS n FROM o GROUP BY 1, 2, 3")
def _(spark, d):
    found = volumes.objects(mask(spark, d), KEYS)
    first = F.min(F.struct("row", "col"))
    return found.groupBy("image_id", "object").agg(first.alias("f"), F.count("*").alias("n")).select("image_id", F.col("f.row").alias("first_row"), F.col("f.col").alias("first_col"), "n")


@query("largest_object", MASK.replace("WITH p", "WITH RECURSIVE p") + f", {_reach}, o AS (SELECT image_id, row, col, min(label) AS label FROM r GROUP BY 1, 2, 3), b AS (SELECT image_id, label FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, label) = 1) SELECT image_id, row, col FROM o JOIN b USING (image_id, label)")
def _(spark, d):
    return volumes.largest_object(mask(spark, d), KEYS)


@query("mask_holes", MASK.replace("WITH p", "WITH RECURSIVE p") + """, g AS (SELECT image_id, a::INT AS row, b::INT AS col FROM (SELECT DISTINCT image_id FROM m), range(0, 24) s(a), range(0, 16) t(b)), e AS (SELECT * FROM g ANTI JOIN m USING (image_id, row, col)),
r AS (SELECT * FROM e WHERE row IN (0, 23) OR col IN (0, 15) UNION SELECT e.* FROM r JOIN e ON e.image_id = r.image_id AND abs(e.row - r.row) + abs(e.col - r.col) = 1) SELECT image_id, row, col FROM e ANTI JOIN r USING (image_id, row, col)""")
def _(spark, d):
    return volumes.holes(mask(spark, d), KEYS, 24, 16)


@query("mask_erosion", MASK + "SELECT a.image_id, a.row, a.col FROM m a JOIN m b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 9")
def _(spark, d):
    return volumes.erode(mask(spark, d), KEYS)


@query("mask_volume", "WITH p AS (SELECT user_id % 4 AS image_id, floor(value) AS val FROM events), x AS (SELECT image_id, max(val) AS m FROM p GROUP BY 1) SELECT p.image_id, count(*) * 2.5::DOUBLE AS volume FROM p JOIN x ON p.image_id = x.image_id AND val = m GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "events").select((F.col("user_id") % 4).alias("image_id"), F.floor("value").alias("val"))
    return volumes.mask_volume(p, KEYS, 2.5)


@query("motion_fft", PIXELS + """, k AS (SELECT image_id, col, k, sum(val * cos(2 * pi() * k * row / 24)) AS re, sum(val * sin(2 * pi() * k * row / 24)) AS im FROM p, range(1, 24) t(k) GROUP BY ALL) SELECT image_id, col, round(sum(sqrt(re * re + im * im)), 3) AS motion FROM k GROUP BY ALL""")
def _(spark, d):
    return lines.motion(pixels(spark, d), ["image_id", "col"], "row", 24).withColumn("motion", F.round("motion", 3))


@query("motion_mask", PIXELS + ", q AS (SELECT image_id, quantile_cont(val, 0.9) AS q FROM p GROUP BY 1) SELECT image_id, row, col FROM p JOIN q USING (image_id) WHERE val >= q")
def _(spark, d):
    return volumes.over_percentile(pixels(spark, d), KEYS, "val", 0.9).select("image_id", "row", "col")


@query("image_stack", """WITH o AS (SELECT p_partkey AS obj, p_size % 4 + 2 AS w, p_size % 3 + 2 AS h, p_partkey % 3 + 1 AS n, p_size::DOUBLE AS start FROM part), c AS (SELECT *, unnest(range(0, w * h * n * 2)) AS i FROM o)
SELECT obj, i // (w * h) AS image_id, i // (w * h) % n AS slice, i // (w * h * n) AS step, start + i // (w * h * n) * 0.5 AS ts, i // w % h AS row, i % w AS col,
CASE WHEN abs(sqrt(((i % w - 1.5) / 1.5) ** 2 + ((i // w % h - 1) / 1.0) ** 2 + ((i // (w * h) % n - 1) / 1.0) ** 2) - 1) <= 0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS val FROM c""")
def _(spark, d):
    """A generated stack for every part, with a size, a number of slices and a start of its own."""
    size = F.col("p_size").cast("bigint")
    objects = table(spark, d, "part").select(F.col("p_partkey").alias("obj"), (size % 4 + 2).alias("width"), (size % 3 + 2).alias("height"), (F.col("p_partkey") % 3 + 1).alias("slices"), F.lit(2).alias("steps"), size.cast("double").alias("start"), F.lit(0.5).alias("interval"))
    return volumes.ellipsoid(volumes.image_stacks(objects, ["obj"]), (1.5, 1, 1), (1.5, 1, 1), 0.2)


@query("image_from_array", "SELECT vec_id, i // 8 AS image_id, i // 8 % 4 AS slice, i // 32 AS step, i // 32 * 2.0::DOUBLE AS ts, i // 4 % 2 AS row, i % 4 AS col, round(embedding[i + 1]::DOUBLE, 6) AS val FROM embeddings, range(0, 64) t(i)")
def _(spark, d):
    """Every vector as a 4-D array of 4 × 2 × 4 × 2 values."""
    return volumes.from_flat(table(spark, d, "embeddings"), ["vec_id"], "embedding", (4, 2, 4, 2), 2.0).withColumn("val", F.round("val", 6))


def contours(spark, d):
    """A user's events as a closed contour: value, minute and hour of each as a point."""
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("at"), vec.vec(F.col("value"), F.minute("ts").cast("double"), F.hour("ts").cast("double")).alias("p"))


CONTOURS = """WITH c AS (SELECT user_id, event_id AS k, value AS x, minute(ts)::DOUBLE AS y, hour(ts)::DOUBLE AS z FROM events),
n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS u, coalesce(lead(y) OVER w, first_value(y) OVER w) AS v, coalesce(lead(z) OVER w, first_value(z) OVER w) AS w FROM c WINDOW w AS (PARTITION BY user_id ORDER BY k)) """


@query("contour_planes", CONTOURS + """, s AS (SELECT user_id, avg(x) AS cx, sum(y * w - z * v) AS a, sum(z * u - x * w) AS b, sum(x * v - y * u) AS c, sum(sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2)) AS length FROM n GROUP BY 1)
SELECT user_id, round(cx, 4) AS center_x, round(sqrt(a * a + b * b + c * c) / 2, 3) AS area, round(sqrt(a * a + b * b + c * c) / 2 * 1.5, 3) AS volume, round(length, 4) AS length FROM s""")
def _(spark, d):
    found = volumes.contour_planes(contours(spark, d), ["user_id"])
    return found.select("user_id", F.round("center.x", 4).alias("center_x"), F.round("area", 3).alias("area"), F.round(F.col("area") * 1.5, 3).alias("volume"), F.round("length", 4).alias("length"))


@query("contour_resample", CONTOURS + """, d AS (SELECT *, sqrt((x - u) ** 2 + (y - v) ** 2 + (z - w) ** 2) AS d FROM n), s AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY k) - d AS f, sum(d) OVER (PARTITION BY user_id) / 10 AS unit FROM d),
h AS (SELECT user_id, i, x + (u - x) * ((i * unit - f) / d) AS x FROM s, range(0, 10) t(i) WHERE d > 0 AND i * unit >= f - 1e-9 * unit AND i * unit < f + d - 1e-9 * unit) SELECT user_id, i AS k, round(x, 4) AS x FROM h""")
def _(spark, d):
    found = volumes.resample_contour(contours(spark, d), ["user_id"], 10)
    return found.select("user_id", "k", F.round("p.x", 4).alias("x"))


@query("contour_mask", CONTOURS + """, g AS (SELECT a AS row, b AS col, b * 2 + 0.25::DOUBLE AS gx, a * 1.5 + 0.3::DOUBLE AS gy FROM range(0, 40) s(a), range(0, 40) t(b))
SELECT user_id AS poly, row, col, (1 + user_id % 2)::INT AS label FROM n, g WHERE (y > gy) <> (v > gy) AND gx < (u - x) * (gy - y) / (v - y) + x GROUP BY user_id, row, col HAVING count(*) % 2 = 1""")
def _(spark, d):
    """The pixels of a grid within every user's contour, seen along z, labelled by kind of contour."""
    edges = volumes.closed_pairs(contours(spark, d), ["user_id"]).select(F.col("user_id").alias("poly"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"))
    grid = spark.range(1600).select("id", (F.col("id") % 40 * 2 + 0.25).alias("x"), (F.floor(F.col("id") / 40) * 1.5 + 0.3).alias("y"))
    inside = spatial.pixels_in_polygon(grid, edges, 4.0)
    return inside.select("poly", F.floor(F.col("id") / 40).alias("row"), (F.col("id") % 40).alias("col"), (1 + F.col("poly") % 2).cast("int").alias("label"))


_corners = "list_reverse_sort([{'val': px + py, 'x': px, 'y': py}, {'val': qx + qy, 'x': qx, 'y': qy}, {'val': rx + ry, 'x': rx, 'y': ry}, {'val': sx + sy, 'x': sx, 'y': sy}])"
_cut = lambda i, j, c="x": f"(s[{i}].{c} + (s[{j}].{c} - s[{i}].{c}) * ((s[{i}].val - 0.02) / (s[{i}].val - s[{j}].val)))"
_sum = lambda *e: f"round(({' + '.join(_cut(*x) for x in e)}) / 3, 5)"


@query("iso_surface", POINTS + f""", t AS (SELECT vec_id, {_corners} AS s FROM e), n AS (SELECT vec_id, s, len(list_filter(s, lambda c: c.val > 0.02)) AS above FROM t)
SELECT vec_id AS elem_id, 0 AS part, {_sum((1, 2), (1, 3), (1, 4))} AS x FROM n WHERE above = 1 UNION ALL SELECT vec_id, 0, {_sum((1, 3), (1, 4), (2, 4))} FROM n WHERE above = 2
UNION ALL SELECT vec_id, 1, {_sum((1, 3), (2, 4), (2, 3))} FROM n WHERE above = 2 UNION ALL SELECT vec_id, 0, {_sum((1, 4), (2, 4), (3, 4))} FROM n WHERE above = 3""")
def _(spark, d):
    corners = F.array(*(F.struct((F.col(c)["x"] + F.col(c)["y"]).alias("val"), F.col(c).alias("p")) for c in "pqrs"))
    found = volumes.iso_triangles(points(spark, d).select(F.col("vec_id").alias("elem_id"), corners.alias("corners")), 0.02)
    return found.select("elem_id", "part", F.round((F.col("a.x") + F.col("b.x") + F.col("c.x")) / 3, 5).alias("x"))


@query("slice_surface", POINTS + """, n AS (SELECT vec_id, (px > 0.02)::INT + (qx > 0.02)::INT + (rx > 0.02)::INT + (sx > 0.02)::INT AS above FROM e) SELECT vec_id AS elem_id, CASE above WHEN 2 THEN 2 ELSE 1 END::BIGINT AS triangles, 0.02::DOUBLE AS x FROM n WHERE above BETWEEN 1 AND 3""")
def _(spark, d):
    found = volumes.slice_triangles(points(spark, d).select(F.col("vec_id").alias("elem_id"), F.array(*"pqrs").alias("corners")), vec.vec(0.02, 0, 0), vec.vec(1, 0, 0))
    return found.groupBy("elem_id").agg(F.count("*").alias("triangles"), F.round(F.max("c.x"), 9).alias("x"))


@query("low_pass", PIXELS + """, k AS (SELECT dr, dc, sum(cos(2 * pi() * (u * dr / 24 + v * dc / 16))) / 384 AS g FROM range(0, 24) a(u), range(0, 16) b(v), range(-23, 24) c(dr), range(-15, 16) d(dc) WHERE least(u, 24 - u) ** 2 + least(v, 16 - v) ** 2 <= 9 GROUP BY 1, 2)
SELECT image_id, r::INT AS row, c::INT AS col, round(sum(val * g), 4) AS val FROM p, range(0, 24) s(r), range(0, 16) t(c), k WHERE dr = r - row AND dc = c - col GROUP BY 1, 2, 3""")
def _(spark, d):
    return lines.low_pass(pixels(spark, d), KEYS, {"row": 24, "col": 16}, 3.0).withColumn("val", F.round("val", 4))


@query("mask_contours", MASK + "SELECT m.image_id, m.row, m.col, dr, dc FROM m, (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) v(dr, dc) WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.image_id = m.image_id AND n.row = m.row + dr AND n.col = m.col + dc)")
def _(spark, d):
    return volumes.mask_edges(mask(spark, d), KEYS)
