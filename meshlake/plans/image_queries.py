"""Image operators, over events as pixels: a user's group is an image, hours and users' numbers its rows and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import images
from .registry import query, table

PIXELS = "WITH p AS (SELECT user_id % 4 AS image_id, hour(ts)::INT AS row, (user_id // 4 % 16)::INT AS col, round(sum(value), 4) AS val FROM events GROUP BY 1, 2, 3) "


def pixels(spark, d):
    e = table(spark, d, "events")
    return e.groupBy((F.col("user_id") % 4).alias("image_id"), F.hour("ts").alias("row"), (F.floor(F.col("user_id") / 4) % 16).cast("int").alias("col")).agg(F.round(F.sum("value"), 4).alias("val"))


KEYS = ["image_id"]


@query("point_operations", "SELECT event_id, CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END::DOUBLE AS mask, CASE WHEN value BETWEEN 10 AND 60 THEN round(value, 6) ELSE 0 END AS threshold, round(value * 2.5 - 1, 6) AS scaled FROM events")
def _(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", images.binary_mask(v, 20).alias("mask"), F.round(images.threshold(v, 10, 60), 6).alias("threshold"), F.round(images.slope_intercept(v, 2.5, -1), 6).alias("scaled"))


@query("normalize_rescale", PIXELS + """, m AS (SELECT image_id, min(val) AS a, max(val) AS b FROM p GROUP BY 1)
SELECT image_id, row, col, round((val - a) / b, 6) AS norm, round(CASE WHEN a = b THEN val * 255 ELSE (val - a) / (b - a) * 255 END, 4) AS scaled FROM p JOIN m USING (image_id)""")
def _(spark, d):
    both = images.rescale(images.normalise(pixels(spark, d), KEYS, "val"), KEYS, "val", 0.0, 255.0)
    return both.select("image_id", "row", "col", F.round("norm", 6).alias("norm"), F.round("scaled", 4).alias("scaled"))


@query("crop_bbox", PIXELS + """, b AS (SELECT image_id, greatest(min(row) - 1, 0) AS r0, least(max(row) + 1, 23) AS r1, greatest(min(col) - 1, 0) AS c0, least(max(col) + 1, 15) AS c1 FROM p WHERE val > 60 GROUP BY 1)
SELECT image_id, row - r0 AS row, col - c0 AS col, val FROM p JOIN b USING (image_id) WHERE row BETWEEN r0 AND r1 AND col BETWEEN c0 AND c1""")
def _(spark, d):
    p = pixels(spark, d)
    return images.crop(p, images.bounding_square(p, KEYS, 60.0, 1, 24, 16), KEYS)


@query("extend_pad", PIXELS + """SELECT i.image_id, r.r::INT AS row, c.c::INT AS col, coalesce(val, 3.0)::DOUBLE AS val FROM (SELECT DISTINCT image_id FROM p) i, range(0, 28) r(r), range(0, 20) c(c) LEFT JOIN p ON p.image_id = i.image_id AND p.row + 2 = r.r AND p.col + 2 = c.c""")
def _(spark, d):
    p = pixels(spark, d)
    return images.extend(p, p.select("image_id").distinct(), KEYS, 24, 16, 2, 3.0)


@query("merge_colinear", """WITH u AS (SELECT c_nationkey AS image_id, 0 AS row, (c_custkey % 50)::INT AS col, max(c_acctbal) AS val FROM customer GROUP BY 1, 2, 3 UNION ALL SELECT s_nationkey, 0, (s_suppkey % 50)::INT, max(s_acctbal) FROM supplier GROUP BY 1, 2, 3)
SELECT image_id, row, col, max(val) AS max_val, round(avg(val), 4) AS avg_val FROM u GROUP BY 1, 2, 3""")
def _(spark, d):
    part = lambda t, n, k, v: table(spark, d, t).groupBy(F.col(n).alias("image_id"), F.lit(0).alias("row"), (F.col(k) % 50).cast("int").alias("col")).agg(F.max(v).alias("val"))
    stacks = [part("customer", "c_nationkey", "c_custkey", "c_acctbal"), part("supplier", "s_nationkey", "s_suppkey", "s_acctbal")]
    most = images.merge(stacks, KEYS, "max").withColumnRenamed("val", "max_val")
    mean = images.merge(stacks, KEYS, "avg").withColumn("avg_val", F.round("val", 4)).drop("val")
    return most.join(mean, ["image_id", "row", "col"])


@query("dilate_max", PIXELS + """SELECT a.image_id, a.row, a.col, a.val, max(b.val) AS dilated FROM p a JOIN p b ON a.image_id = b.image_id AND abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2, 3, 4""")
def _(spark, d):
    return images.dilate(pixels(spark, d), KEYS)


@query("boundary_points", PIXELS + "SELECT image_id, row, col FROM p a WHERE val >= 60 AND EXISTS (SELECT 1 FROM p b WHERE a.image_id = b.image_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND b.val < 60)")
def _(spark, d):
    return images.boundary(pixels(spark, d), KEYS, 60.0).select("image_id", "row", "col")


@query("resample_bilinear", PIXELS + """, g AS (SELECT i.image_id, r.r AS row, c.c AS col, r.r * 23.0::DOUBLE / 11.0::DOUBLE AS y, c.c * 15.0::DOUBLE / 7.0::DOUBLE AS x FROM (SELECT DISTINCT image_id FROM p) i, range(0, 12) r(r), range(0, 8) c(c)),
k AS (SELECT image_id, g.row, g.col, floor(y)::BIGINT + dy AS sr, floor(x)::BIGINT + dx AS sc, (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
SELECT k.image_id, k.row::INT AS row, k.col::INT AS col, round(sum(coalesce(p.val, 0) * w), 4) AS val FROM k LEFT JOIN p ON p.image_id = k.image_id AND p.row = sr AND p.col = sc GROUP BY 1, 2, 3""")
def _(spark, d):
    out = images.resample(pixels(spark, d), KEYS, 24, 16, 12, 8)
    return out.withColumn("val", F.round("val", 4))


@query("swap_axes", PIXELS + "SELECT image_id, 15 - col AS row, row AS col, val FROM p")
def _(spark, d):
    return images.swap_axes(pixels(spark, d), 16)


@query("image_minmax", PIXELS + "SELECT image_id, min(val) AS imgmin, max(val) AS imgmax, max(row) + 1 AS rows, max(col) + 1 AS cols FROM p GROUP BY 1")
def _(spark, d):
    return images.image_range(pixels(spark, d), KEYS)
