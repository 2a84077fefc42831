"""Matrix algebra and gather, over embeddings as a dense matrix and line items as an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import matrix
from .registry import query, table


def rounded(df, digits: int = 6):
    return df.withColumn("vals", F.transform("vals", lambda v: scalars.round_signed(v, digits)))


def embedding_matrix(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda v: v.cast("double")).alias("vals"))


@query("mat_scalar_ops", "SELECT vec_id AS row_id, list_transform(embedding, lambda v, i: round(CASE WHEN vec_id >= 10 AND i - 1 < 4 THEN v::DOUBLE * 2.5 ELSE v::DOUBLE END, 6)) AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.scalar_op(embedding_matrix(spark, d), "mul", 2.5, rows=(10, 1 << 60), cols=(0, 4)))


@query("mat_mat_ops", "SELECT a.vec_id AS row_id, list_transform(a.embedding, lambda v, i: round(v::DOUBLE + CASE WHEN b.vec_id IS NULL THEN 0 ELSE b.embedding[i]::DOUBLE END, 6)) AS vals FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id * 2")
def _(spark, d):
    a = embedding_matrix(spark, d)
    half = a.where("row_id % 2 = 0").withColumn("row_id", F.floor(F.col("row_id") / 2))
    return rounded(matrix.matrix_op(a, half, "add"))


@query("mat_submatrix", "SELECT vec_id - 5 AS row_id, list_transform(embedding[3:6], lambda v: round(v::DOUBLE, 6)) AS vals FROM embeddings WHERE vec_id BETWEEN 5 AND 104")
def _(spark, d):
    return rounded(matrix.submatrix(embedding_matrix(spark, d), 100, 4, 5, 2))


@query("mat_reorder", "SELECT vec_id AS row_id, [round(embedding[3]::DOUBLE, 6), round(embedding[1]::DOUBLE, 6), round(embedding[2]::DOUBLE, 6)] AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.reorder(embedding_matrix(spark, d), [2, 0, 1]))


@query("mat_reshape", """WITH c AS (SELECT vec_id * 64 + i - 1 AS k, round(embedding[i]::DOUBLE, 6) AS v FROM embeddings, range(1, 65) t(i))
SELECT k // 48 AS row_id, list(v ORDER BY k) AS vals FROM c GROUP BY 1""")
def _(spark, d):
    return rounded(matrix.reshape(embedding_matrix(spark, d), 64, 48))


@query("mat_apply_cell", "SELECT vec_id AS row_id, list_transform(embedding, lambda v, i: round(v::DOUBLE * vec_id + i - 1, 6)) AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.apply_cell(embedding_matrix(spark, d), lambda v, n, m: v * n + m))


@query("mat_append_remove", """WITH a AS (SELECT vec_id AS row_id, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS vals FROM embeddings), n AS (SELECT max(row_id) + 1 AS n FROM a)
SELECT row_id - (row_id > 7)::BIGINT AS row_id, vals FROM (SELECT * FROM a UNION ALL SELECT row_id + n, vals FROM a, n) WHERE row_id <> 7""")
def _(spark, d):
    a = embedding_matrix(spark, d)
    return rounded(matrix.remove_row(matrix.append(a, a, matrix.n_rows(a)), 7))


@query("mat_resize", "SELECT vec_id AS row_id, list_transform(list_concat(embedding::DOUBLE[], [0.0, 0.0, 0.0]), lambda v: round(v, 6)) AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.resize(embedding_matrix(spark, d), 67))


@query("mat_get_at", """WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT vec_id - n + 100 AS row_id, list_transform(embedding[61:64], lambda v: round(v::DOUBLE, 6)) AS vals FROM embeddings, n WHERE vec_id >= n - 100""")
def _(spark, d):
    return rounded(matrix.get_at(embedding_matrix(spark, d), slice(-100, None), slice(-4, None), 64))


@query("mat_row_write", "SELECT vec_id AS row_id, CASE WHEN vec_id = 3 THEN list_concat([1.5, 2.5], list_transform(embedding[3:], lambda v: round(v::DOUBLE, 6))) ELSE list_transform(embedding, lambda v: round(v::DOUBLE, 6)) END AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.write_row(embedding_matrix(spark, d), 3, [1.5, 2.5]))


@query("mat_apply_row", """SELECT vec_id AS row_id, CASE WHEN vec_id >= 10 AND vec_id < 200 THEN list_transform(list_reverse(embedding), lambda v: round(v::DOUBLE + vec_id, 6)) ELSE list_transform(embedding, lambda v: round(v::DOUBLE, 6)) END AS vals FROM embeddings""")
def _(spark, d):
    return rounded(matrix.apply_row(embedding_matrix(spark, d), lambda row, n: F.transform(F.reverse(row), lambda v: v + n), (10, 200)))


@query("mat_copy_from", """WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, p_retailprice AS v FROM part), n AS (SELECT count(*) AS n FROM p)
SELECT e.vec_id AS row_id, list(round(coalesce(p.v, e.embedding[i]::DOUBLE), 6) ORDER BY i) AS vals FROM embeddings e, range(1, 65) t(i) LEFT JOIN p ON p.k = e.vec_id * 64 + i - 1 GROUP BY 1""")
def _(spark, d):
    prices = matrix.dense_ids(table(spark, d, "part").select("p_partkey", F.array("p_retailprice").alias("vals")), ["p_partkey"]).select("row_id", "vals")
    return rounded(matrix.copy_from(embedding_matrix(spark, d), prices, 64, 1))


@query("mat_fill", "SELECT vec_id AS row_id, list_transform(embedding, lambda v: 2.5::DOUBLE) AS vals FROM embeddings")
def _(spark, d):
    return matrix.fill(embedding_matrix(spark, d), 2.5)


@query("mat_meta", "SELECT p_partkey, 'brand = ' || p_brand || chr(10) || 'size = ' || p_size || chr(10) || 'type = ' || p_type AS text, p_brand AS brand, NULL::VARCHAR AS absent FROM part")
def _(spark, d):
    meta = F.create_map(F.lit("type"), F.col("p_type"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    texts = table(spark, d, "part").select("p_partkey", matrix.meta_text(meta).alias("text")).withColumn("meta", matrix.meta_of(F.col("text")))
    return texts.select("p_partkey", "text", F.col("meta")["brand"].alias("brand"), F.col("meta")["absent"].alias("absent"))


@query("mat_swap_endian", "SELECT l_orderkey, l_linenumber, (l_partkey % 256) * 16777216 + (l_partkey // 256 % 256) * 65536 + (l_partkey // 65536 % 256) * 256 + l_partkey // 16777216 AS swapped FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", matrix.swap_bytes(F.col("l_partkey"), 4).alias("swapped"))


@query("mat_expression", "SELECT vec_id AS row_id, list_transform(embedding, lambda v, i: round(CASE WHEN vec_id < 100 AND i <= 8 THEN v::DOUBLE * 3 + vec_id - (i - 1) ELSE v::DOUBLE END, 6)) AS vals FROM embeddings")
def _(spark, d):
    return rounded(matrix.apply_expression(embedding_matrix(spark, d), "val * k + n - m", rows=(0, 100), cols=(0, 8), k=3))


@query("mat_from_list", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, [o_orderkey::DOUBLE, o_custkey::DOUBLE, o_totalprice] AS vals FROM orders")
def _(spark, d):
    return matrix.from_rows(table(spark, d, "orders"), ["o_orderkey"], ["o_orderkey", "o_custkey", "o_totalprice"])


@query("mat_iterate", """WITH a AS (SELECT vec_id * 64 + i - 1 AS cell, round(embedding[i]::DOUBLE, 6) AS val FROM embeddings, range(1, 65) t(i))
SELECT cell, val, cell % 3 AS turn, coalesce(vec_id, -1) AS zipped FROM a LEFT JOIN embeddings e ON e.vec_id = cell""")
def _(spark, d):
    flat = matrix.flatten(embedding_matrix(spark, d), 64)
    other = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell"), F.col("vec_id").alias("zipped"))
    return matrix.zip_rows(flat, other, "cell").select("cell", F.round("val", 6).alias("val"), (F.col("cell") % 3).alias("turn"), F.coalesce("zipped", F.lit(-1)).alias("zipped"))


@query("frange_product", "SELECT r_regionkey AS k, 0.25 + a * 0.5 AS x, b * 2.0 AS y FROM region, range(0, 4) s(a), range(0, 3) t(b)")
def _(spark, d):
    grid = matrix.range_product(matrix.frange(spark, 0.25, 2.25, 0.5, "x"), matrix.frange(spark, 0.0, 5.0, 2.0, "y"))
    return grid.crossJoin(F.broadcast(table(spark, d, "region").select(F.col("r_regionkey").alias("k"))))  # regions are a fixed short list


@query("mat_min_max", "SELECT min(list_min(embedding))::DOUBLE AS min_val, max(list_max(embedding))::DOUBLE AS max_val FROM embeddings")
def _(spark, d):
    return matrix.min_max(embedding_matrix(spark, d))


@query("mat_total", "SELECT round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings")
def _(spark, d):
    return matrix.total(embedding_matrix(spark, d)).select(F.round("total", 4).alias("total"))


@query("mat_count_in_range", "SELECT sum(len(list_filter(embedding, lambda v: v::DOUBLE BETWEEN 0.0 AND 0.1)))::BIGINT AS n FROM embeddings")
def _(spark, d):
    return matrix.count_in_range(embedding_matrix(spark, d), 0.0, 0.1)


@query("mat_index_of", """SELECT l_orderkey AS n, 0 AS m FROM lineitem WHERE l_quantity = 17 AND l_orderkey >= 10 ORDER BY 1 LIMIT 1""")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.array("l_quantity").alias("vals"))
    return matrix.index_of(rows, 17.0, (10, 0))


@query("gather_index", """SELECT l_orderkey AS row_id, list(round(p_retailprice, 2) ORDER BY l_linenumber, l_partkey) AS vals FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda c: c["l_partkey"]).alias("ids"))
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("val"))
    return rounded(matrix.gather(lines, prices), 2)


@query("value_functions", """SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS average, round(sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))), 6) AS magnitude, round(embedding[3]::DOUBLE, 6) AS column3 FROM embeddings""")
def _(spark, d):
    e = embedding_matrix(spark, d)
    return e.select(F.col("row_id").alias("vec_id"), *(F.round(scalars.VALUE_FUNCTIONS[f](F.col("vals")), 6).alias(f) for f in ("average", "magnitude", "column3")))


@query("vector_functions", """WITH m AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda v: v::DOUBLE * v::DOUBLE))) AS n FROM embeddings)
SELECT vec_id, round(e[1]::DOUBLE, 6) AS x, round(e[2]::DOUBLE, 6) AS y, round(n, 6) AS uniform_x, 1.0::DOUBLE AS z_magnitude_x, round(n, 6) AS z_magnitude_z FROM m""")
def _(spark, d):
    e, f = embedding_matrix(spark, d), scalars.VECTOR_FUNCTIONS
    v = F.col("vals")
    cols = {"x": f["xyz"](v)["x"], "y": f["xyz"](v)["y"], "uniform_x": f["uniform"](v)["x"], "z_magnitude_x": f["z_magnitude"](v)["x"], "z_magnitude_z": f["z_magnitude"](v)["z"]}
    return e.select(F.col("row_id").alias("vec_id"), *(F.round(c, 6).alias(k) for k, c in cols.items()))


@query("unit_functions", """WITH u AS (SELECT event_id, value - floor(value) AS x FROM events)
SELECT event_id, round(1 - x, 6) AS inverse, round(sin(0.5 * x * pi()), 6) AS sin, round(1 - cos(0.5 * x * pi()), 6) AS cos, round((1 - cos(x * pi())) / 2, 6) AS smooth FROM u""")
def _(spark, d):
    x = F.col("value") - F.floor("value")
    return table(spark, d, "events").select("event_id", *(F.round(scalars.UNIT_FUNCTIONS[k](x), 6).alias(k) for k in ("inverse", "sin", "cos", "smooth")))


@query("weighted_rows", """SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: v::DOUBLE / i)), 6) AS val FROM embeddings""")
def _(spark, d):
    weighted = matrix.weighted(F.col("vals"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: 1.0 / i))
    return embedding_matrix(spark, d).select(F.col("row_id").alias("vec_id"), F.round(weighted, 6).alias("val"))


@query("range_partition", """WITH n AS (SELECT count(*) AS n FROM orders)
SELECT part, count(*) AS rows_in_part, min(k) AS first_k FROM (SELECT least(floor(k * 7 / n)::BIGINT, 6) AS part, k FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders), n) GROUP BY 1""")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    n = orders.agg(F.count("*").alias("n"))
    numbered = matrix.dense_ids(orders, ["o_orderkey"], "k").crossJoin(F.broadcast(n))  # one row
    part = F.least(F.floor(F.col("k") * 7 / F.col("n")), F.lit(6)).alias("part")
    return numbered.groupBy(part).agg(F.count("*").alias("rows_in_part"), F.min("k").alias("first_k"))
