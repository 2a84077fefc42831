"""Region and timestep aggregation, over line items: nations as regions, ship years as time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agg, measures
from .geometry_queries import POINTS, points
from .registry import query, table

BASE = "WITH b AS (SELECT c_nationkey AS region, year(l_shipdate) AS year, l_extendedprice AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey) "


def measured(spark, d):
    """(region, year, v) of every line: the index joins from lines over orders to customers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", F.year("l_shipdate").alias("year"), F.col("l_extendedprice").alias("v"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("region"))
    return lines.join(orders.join(customers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")).select("region", "year", "v")


@query("region_sum_field", BASE + "SELECT year, region, round(sum(v), 2) AS total FROM b WHERE region < 10 GROUP BY 1, 2")
def _(spark, d):
    return agg.region_sum(measured(spark, d), "region", "v", list(range(10)), ["year"]).withColumn("total", F.round("total", 2))


@query("region_sum_spread", "WITH s AS (SELECT c_nationkey, sum(c_acctbal) AS total FROM customer WHERE c_nationkey IN (1, 2, 3) GROUP BY 1) SELECT c_custkey, round(coalesce(total, 0), 2) AS total FROM customer LEFT JOIN s USING (c_nationkey)")
def _(spark, d):
    return agg.spread_region_sum(table(spark, d, "customer"), "c_nationkey", "c_acctbal", [1, 2, 3]).select("c_custkey", F.round("total", 2).alias("total"))


@query("volume_summary", BASE + """, y AS (SELECT region, year, sum(v) AS v FROM b GROUP BY 1, 2), t AS (SELECT sum(v) AS v FROM y GROUP BY year), m AS (SELECT arg_min(year, (v, year)) AS t FROM y GROUP BY region)
SELECT round(min(v), 2) AS esv, round(max(v), 2) AS edv, round(max(v) - min(v), 2) AS stroke, round((max(v) - min(v)) * 100 / max(v), 4) AS ef, (SELECT round(coalesce(stddev_samp(t), 0), 6) FROM m) AS sdi FROM t""")
def _(spark, d):
    yearly = measured(spark, d).groupBy("region", "year").agg(F.sum("v").alias("v"))
    s = agg.volume_summary(yearly, "region", "year", "v")
    return s.select(*(F.round(c, 2).alias(c) for c in ("esv", "edv", "stroke")), F.round("ef", 4).alias("ef"), F.round("sdi", 6).alias("sdi"))


@query("squeeze_ratio", BASE + ", y AS (SELECT region, year, sum(v) AS v FROM b GROUP BY 1, 2) SELECT region, year, round(CASE WHEN first_value(v) OVER w = 0 THEN 0 ELSE v / first_value(v) OVER w END, 6) AS ratio FROM y WINDOW w AS (PARTITION BY region ORDER BY year)")
def _(spark, d):
    yearly = measured(spark, d).groupBy("region", "year").agg(F.sum("v").alias("v"))
    return agg.ratio_to_first(yearly, "region", "year", "v").select("region", "year", F.round("ratio", 6).alias("ratio"))


@query("trimmed_mean", "WITH s AS (SELECT l_returnflag, avg(l_extendedprice) AS m, coalesce(stddev_samp(l_extendedprice), 0) AS s FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(l_extendedprice), 4) AS trimmed_mean, count(*) AS n_kept FROM lineitem JOIN s USING (l_returnflag) WHERE abs(l_extendedprice - m) <= s GROUP BY 1")
def _(spark, d):
    return agg.trimmed_mean(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice").withColumn("trimmed_mean", F.round("trimmed_mean", 4))


@query("field_minmax", "SELECT p_brand, min(p_retailprice) AS min_val, max(p_retailprice) AS max_val FROM part GROUP BY 1")
def _(spark, d):
    return agg.min_max(table(spark, d, "part"), ["p_brand"], "p_retailprice")


@query("range_union", "SELECT least((SELECT min(c_acctbal) FROM customer), (SELECT min(s_acctbal) FROM supplier)) AS min_val, greatest((SELECT max(c_acctbal) FROM customer), (SELECT max(s_acctbal) FROM supplier)) AS max_val")
def _(spark, d):
    return agg.union_range([(table(spark, d, "customer"), "c_acctbal"), (table(spark, d, "supplier"), "s_acctbal")])


@query("histogram_int", "SELECT b AS bin, count(l_quantity) AS n FROM range(0, 60) r(b) LEFT JOIN lineitem ON floor(l_quantity + 0.5) = b GROUP BY 1")
def _(spark, d):
    return agg.histogram(table(spark, d, "lineitem").select("l_quantity"), "l_quantity", 0, 60)


#: SQL for the extremes of a histogram h (bin, n) of bins from 0 to {last}.
EXTREMA = """, f AS (SELECT min(bin) AS first FROM h WHERE n > 0), v AS (SELECT bin, CASE WHEN bin = first THEN 0 ELSE n END::DOUBLE AS v FROM h, f), k AS (SELECT k, exp(-k * k / 18.0) AS w FROM range(-12, 13) t(k)),
s AS (SELECT a.bin, any_value(a.v) AS v, sum(w / (SELECT sum(w) FROM k) * b.v) AS s FROM v a, k, v b WHERE b.bin = least(((a.bin + k) % {twice} + {twice}) % {twice}, {twice} - 1 - ((a.bin + k) % {twice} + {twice}) % {twice}) GROUP BY 1),
n AS (SELECT a.bin, any_value(a.v) AS v, any_value(a.s) AS s, max(b.s) AS hi, min(b.s) AS lo FROM s a JOIN s b ON abs(a.bin - b.bin) BETWEEN 1 AND 5 GROUP BY 1),
x AS (SELECT bin, v, CASE WHEN bin = first THEN 'min' WHEN bin NOT IN (0, {last}) AND s > hi THEN 'max' WHEN bin NOT IN (0, {last}) AND s < lo THEN 'min' END AS kind FROM n, f),
l AS (SELECT a.bin, a.v, max(b.bin) FILTER (b.bin < a.bin) AS l, min(b.bin) FILTER (b.bin > a.bin) AS r, arg_max(b.v, b.bin) FILTER (b.bin < a.bin) AS lv, arg_min(b.v, b.bin) FILTER (b.bin > a.bin) AS rv FROM x a LEFT JOIN x b ON b.kind = 'min' WHERE a.kind = 'max' GROUP BY 1, 2),
m AS (SELECT * FROM l WHERE coalesce(v - lv > (SELECT avg(v) * 0.5 FROM v), false) OR coalesce(rv - v > (SELECT avg(v) * 0.5 FROM v), false)),
y AS (SELECT bin, v AS n, 'max' AS kind FROM m UNION ALL SELECT bin, v, 'min' FROM x WHERE kind = 'min' AND (bin IN (SELECT l FROM m) OR bin IN (SELECT r FROM m))) """


@query("histogram_extrema", "WITH h AS (SELECT b AS bin, count(o_orderkey) AS n FROM range(0, 120) t(b) LEFT JOIN orders ON floor(o_totalprice / 5000 + 0.5) = b GROUP BY 1)" + EXTREMA.format(last=119, twice=240) + "SELECT * FROM y")
def _(spark, d):
    """Peaks and valleys of the prices of orders."""
    h = agg.histogram(table(spark, d, "orders").select((F.col("o_totalprice") / 5000).alias("v")), "v", 0, 120)
    return measures.histogram_extrema(h)


@query("aha_bucket", POINTS + """, a AS (SELECT vec_id, (atan2(py, px) + pi()) / (2 * pi()) AS t, pz * 3 + 0.5 AS h FROM e),
s AS (SELECT *, [2, 3, 4, 5, 6, 1][least(floor(t * 6), 5)::INT + 1] AS six, [13, 14, 15, 16][(floor(t * 4 + 5 / 6.0)::INT % 4) + 1] AS four FROM a)
SELECT vec_id, (CASE WHEN h < 0 THEN 18 WHEN h < 0.9 / 3 THEN six WHEN h < 0.9 * 2 / 3 THEN six + 6 WHEN h < 0.9 THEN four ELSE 17 END)::BIGINT AS region, (18 + least(floor(t * 6), 5))::BIGINT AS cavity FROM s""")
def _(spark, d):
    import math

    turn = (F.atan2(F.col("p.y"), F.col("p.x")) + math.pi) / (2 * math.pi)
    height = F.col("p.z") * 3 + 0.5
    return points(spark, d).select("vec_id", agg.heart_segment(height, turn, 0.9).alias("region"), agg.cavity_segment(turn).alias("cavity"))


@query("dataset_profile", """SELECT 'part' AS name, count(*) AS n, 6 AS m FROM part UNION ALL SELECT 'orders', count(*), 6 FROM orders UNION ALL SELECT 'lineitem', count(*), 11 FROM lineitem""")
def _(spark, d):
    return agg.profile({name: table(spark, d, name) for name in ("part", "orders", "lineitem")})


@query("weighted_energy", "SELECT year(l_shipdate) AS year, round(sum((l_quantity ** 2 + l_discount ** 2 + l_tax ** 2) * 50), 2) AS energy FROM lineitem GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    return agg.energy(lines, ["year"], ["l_quantity", "l_discount", "l_tax"], 50.0).withColumn("energy", F.round("energy", 2))
