"""Dense matrices as rows (row_id, vals ARRAY<DOUBLE>); row_id is dense and given at the source."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import numbered

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
}


def cells(df: DataFrame) -> DataFrame:
    """(n, m, val) of every cell."""
    return df.select(F.col("row_id").alias("n"), F.posexplode("vals").alias("m", "val"))


def from_cells(df: DataFrame) -> DataFrame:
    """Rows again, cells in the order of m."""
    return df.groupBy(F.col("n").alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("m", "val"))), lambda c: c["val"]).alias("vals"))


def submatrix(df: DataFrame, n: int, m: int, row: int = 0, col: int = 0) -> DataFrame:
    """n rows and m columns from (row, col), numbered from 0."""
    return df.where(F.col("row_id").between(row, row + n - 1)).select((F.col("row_id") - row).alias("row_id"), F.slice("vals", col + 1, m).alias("vals"))


def reorder(df: DataFrame, order: list[int]) -> DataFrame:
    return df.withColumn("vals", F.array(*(F.get("vals", k) for k in order)))


def scalar_op(df: DataFrame, op: str, k: float, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """A scalar applied to the cells of a window [first, last) of rows and columns."""
    return apply_cell(df, lambda v, n, m: OPS[op](v, F.lit(float(k))), rows, cols)


def apply_cell(df: DataFrame, f: Callable[[Column, Column, Column], Column], rows=None, cols=None) -> DataFrame:
    def inside(m: Column) -> Column:
        test = F.lit(True)
        if rows:
            test = test & (F.col("row_id") >= rows[0]) & (F.col("row_id") < rows[1])
        return test & (m >= cols[0]) & (m < cols[1]) if cols else test

    return df.withColumn("vals", F.transform("vals", lambda v, m: F.when(inside(m), f(v, F.col("row_id"), m)).otherwise(v)))


def matrix_op(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Cell by cell over the common part; the rest of a stays, as if 0 were added to it in sums: -0.0 is 0.0 there."""
    rest = (lambda x: x + 0.0) if op == "add" else (lambda x: x)
    b = b.select("row_id", F.col("vals").alias("other"))
    # zip_with fills the shorter side with nulls, so the result is cut to a's width.
    both = F.slice(F.zip_with("vals", "other", lambda x, y: F.when(y.isNull(), rest(x)).otherwise(OPS[op](x, y))), F.lit(1), F.size("vals"))
    return a.join(b, "row_id", "left").select("row_id", F.when(F.col("other").isNull(), F.transform("vals", rest)).otherwise(both).alias("vals"))


def reshape(df: DataFrame, width: int, m: int) -> DataFrame:
    """Rows of m cells in row-major order of rows of `width` cells."""
    at = F.col("n") * width + F.col("m")
    flat = cells(df).select(F.floor(at / m).alias("n"), (at % m).alias("m"), "val")
    return from_cells(flat)


def append(a: DataFrame, b: DataFrame, rows: int) -> DataFrame:
    """b's rows after the `rows` rows of a."""
    return a.unionByName(b.withColumn("row_id", F.col("row_id") + rows))


def remove_row(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("row_id") != n).withColumn("row_id", F.col("row_id") - (F.col("row_id") > n).cast("bigint"))


def resize(df: DataFrame, m: int, fill: float = 0.0) -> DataFrame:
    """Rows cut or filled up to m cells."""
    return df.withColumn("vals", F.slice(F.concat("vals", F.array_repeat(F.lit(float(fill)), m)), 1, m))


def index_of(df: DataFrame, value: float, after: tuple[int, int] = (0, 0)) -> DataFrame:
    """(n, m) of the first cell with the value at or after a place; no row if there is none."""
    found = cells(df).where((F.col("val") == value) & ((F.col("n") > after[0]) | ((F.col("n") == after[0]) & (F.col("m") >= after[1]))))
    first = found.agg(F.min(F.struct("n", "m")).alias("at"))
    return first.where("at is not null").select("at.n", "at.m")


def gather(index: DataFrame, values: DataFrame, key: str = "row_id", ids: str = "ids") -> DataFrame:
    """(key, vals): for each row of indexes the values found at them, in order: the join from elements to nodes. Missing ones are null."""
    wide = index.select(key, F.posexplode(ids).alias("pos", "at"))
    joined = wide.join(values.select(F.col("row_id").alias("at"), F.col("val")), "at", "left")
    return joined.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "val"))), lambda c: c["val"]).alias("vals"))


def min_max(df: DataFrame) -> DataFrame:
    """Over arrays first, so one row per row reaches the aggregation."""
    return df.agg(F.min(F.array_min("vals")).alias("min_val"), F.max(F.array_max("vals")).alias("max_val"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(F.aggregate("vals", F.lit(0.0), lambda s, v: s + v)).alias("total"))


def count_in_range(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.agg(F.sum(F.size(F.filter("vals", lambda v: v.between(low, high)))).cast("bigint").alias("n"))


def n_rows(df: DataFrame) -> int:
    """Rows of a matrix: the greatest number and one; 0 of an empty one."""
    greatest = df.agg(F.max("row_id")).first()[0]
    return 0 if greatest is None else greatest + 1


def get_at(df: DataFrame, rows: slice, cols: slice, width: int) -> DataFrame:
    """A window of rows and columns, numbered from 0; negative bounds count from the end."""
    (a, b, _), (c, d, _) = rows.indices(n_rows(df)), cols.indices(width)
    return submatrix(df, b - a, d - c, a, c)


def write_row(df: DataFrame, n: int, values: list[float]) -> DataFrame:
    """The first cells of row n replaced by values; what is beyond its width is left out."""
    new = F.slice(F.concat(F.lit([float(v) for v in values]), F.slice("vals", len(values) + 1, 1 << 30)), F.lit(1), F.size("vals"))
    return df.withColumn("vals", F.when(F.col("row_id") == n, new).otherwise(F.col("vals")))


def apply_row(df: DataFrame, f: Callable[[Column, Column], Column], rows: tuple[int, int]) -> DataFrame:
    """Rows [first, last) replaced by f of the row and its number."""
    inside = (F.col("row_id") >= rows[0]) & (F.col("row_id") < rows[1])
    return df.withColumn("vals", F.when(inside, f(F.col("vals"), F.col("row_id"))).otherwise(F.col("vals")))


def copy_from(a: DataFrame, b: DataFrame, width: int, other_width: int) -> DataFrame:
    """a with the cells of b over its first ones in row-major order; shapes may differ."""
    new = reshape(b, other_width, width).select("row_id", F.col("vals").alias("_new"))
    filled = F.concat("_new", F.slice("vals", F.size("_new") + 1, F.lit(width)))
    return a.join(new, "row_id", "left").select("row_id", F.when(F.col("_new").isNull(), F.col("vals")).otherwise(filled).alias("vals"))


def fill(df: DataFrame, value: float) -> DataFrame:
    return df.withColumn("vals", F.transform("vals", lambda v: F.lit(float(value))))


def from_list(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """A matrix of Python lists, which must have one length."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in length")
    return spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(rows)], "row_id bigint, vals array<double>")


def from_rows(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """A matrix of columns of a table, its rows in an order; columns must be numbers, of one kind once they are doubles."""
    kinds = dict(df.dtypes)
    wrong = [c for c in columns if kinds[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double") and not kinds[c].startswith("decimal")]
    if wrong:
        raise ValueError(f"columns {wrong} are no numbers")
    return dense_ids(df.select(*dict.fromkeys([*order, *columns])), order).select("row_id", F.array(*(F.col(c).cast("double") for c in columns)).alias("vals"))


def flatten(df: DataFrame, width: int) -> DataFrame:
    """(cell, val) of every cell, numbered in row-major order."""
    return cells(df).select((F.col("n") * width + F.col("m")).alias("cell"), "val")


def zip_rows(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a's rows with b's of the same number; null beyond b's end."""
    return a.join(b, key, "left")


def frange(spark: SparkSession, start: float, stop: float, step: float, out: str = "x") -> DataFrame:
    """start, start + step, ... below stop; each value is computed from its number, so errors do not add up."""
    if step <= 0:
        raise ValueError("the step must be positive")
    n = max(0, math.ceil((stop - start) / step - 1e-9))
    return spark.range(n).select((start + F.col("id") * float(step)).alias(out))


def range_product(*ranges: DataFrame) -> DataFrame:
    """All combinations of values of ranges: the product is what is asked for."""
    return reduce(lambda a, b: a.crossJoin(b), ranges)


def weighted(values: Column, weights: Column) -> Column:
    """Sum of values times weights."""
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def meta_text(meta: Column) -> Column:
    """A map of strings as lines `key = value`, by key."""
    entries = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat_ws(" = ", e["key"], e["value"]))
    return F.array_join(entries, "\n")


def meta_of(text: Column) -> Column:
    """The map of lines `key = value`; other lines are left out."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^=]*)=", 1)), F.trim(F.regexp_extract(x, "=(.*)$", 1)))))


def swap_bytes(v: Column, size: int) -> Column:
    """A whole number of so many bytes (at most 7) with their order reversed, unsigned."""
    byte = lambda k: F.shiftrightunsigned(v.cast("bigint"), 8 * k).bitwiseAND(F.lit(255))
    return reduce(lambda a, b: a + b, (F.shiftleft(byte(k), 8 * (size - 1 - k)) for k in range(size)))


def apply_expression(df: DataFrame, expression: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, **values: float) -> DataFrame:
    """A SQL expression over the cells of a window: val is the cell, n and m its row and column, others are given by name."""
    named = df.select("*", F.col("row_id").alias("n"), *(F.lit(v).alias(k) for k, v in values.items()))
    inside = [f"n >= {int(rows[0])} AND n < {int(rows[1])}"] if rows else []
    inside += [f"m >= {int(cols[0])} AND m < {int(cols[1])}"] if cols else []
    new = F.expr(f"transform(vals, (val, m) -> CASE WHEN {' AND '.join(inside) or 'true'} THEN CAST({expression} AS DOUBLE) ELSE val END)")
    return named.withColumn("vals", new).select(*df.columns)


def dense_ids(df: DataFrame, order: list[str], out: str = "row_id", rows_per_task: int = 1_000_000) -> DataFrame:
    """Dense numbers in an order without sorting everything in one task."""
    return numbered(df, [], order, out, rows_per_task)
