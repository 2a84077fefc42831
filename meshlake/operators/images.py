"""Image stacks as pixels (keys, row, col, val): point operations, boxes, merging and resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def binary_mask(v: Column, t: float) -> Column:
    return F.when(v >= t, 1.0).otherwise(0.0)


def threshold(v: Column, low: float, high: float) -> Column:
    return F.when(v.between(low, high), v).otherwise(0.0)


def with_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the least and greatest value of their keys, from one aggregation joined back."""
    ends = df.groupBy(*keys).agg(F.min(value).alias("_min"), F.max(value).alias("_max"))
    return df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row


def normalise(df: DataFrame, keys: list[str], value: str, out: str = "norm") -> DataFrame:
    """(v - min) / max: by the greatest value, not by the range."""
    return with_range(df, keys, value).withColumn(out, F.when(F.col("_max") == 0, 0.0).otherwise((F.col(value) - F.col("_min")) / F.col("_max"))).drop("_min", "_max")


def rescale(df: DataFrame, keys: list[str], value: str, low: float, high: float, out: str = "scaled") -> DataFrame:
    """To [low, high]; v × high where all values are equal."""
    d = F.col("_max") - F.col("_min")
    scaled = F.when(d == 0, F.col(value) * high).otherwise((F.col(value) - F.col("_min")) / F.when(d != 0, d) * (high - low) + low)
    return with_range(df, keys, value).withColumn(out, scaled).drop("_min", "_max")


def slope_intercept(v: Column, slope: float, inter: float) -> Column:
    return v if (slope, inter) == (1, 0) else v * slope + inter


def bounding_square(df: DataFrame, keys: list[str], t: float, margin: int, rows: int, cols: int) -> DataFrame:
    """Least and greatest row and column with a value over t, widened and clamped."""
    over = df.where(F.col("val") > t).groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    low = lambda c: F.greatest(F.col(c) - margin, F.lit(0)).alias(c)
    high = lambda c, n: F.least(F.col(c) + margin, F.lit(n - 1)).alias(c)
    return over.select(*keys, low("r0"), high("r1", rows), low("c0"), high("c1", cols))


def crop(df: DataFrame, box: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels within their keys' box, counted from its corner."""
    inside = df.join(box, keys).where(F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1")))
    return inside.select(*keys, (F.col("row") - F.col("r0")).alias("row"), (F.col("col") - F.col("c0")).alias("col"), "val")


def extend(df: DataFrame, images: DataFrame, keys: list[str], rows: int, cols: int, margin: int, fill: float) -> DataFrame:
    """Dense images with a margin of `fill` around them; absent pixels are filled, too. images: the distinct keys."""
    grid = images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rows + 2 * margin - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols + 2 * margin - 1))).alias("col"))
    moved = df.select(*keys, (F.col("row") + margin).cast("int").alias("row"), (F.col("col") + margin).cast("int").alias("col"), "val")
    return grid.join(moved, [*keys, "row", "col"], "left").withColumn("val", F.coalesce("val", F.lit(float(fill))))


def merge(frames: list[DataFrame], keys: list[str], how: str = "max") -> DataFrame:
    """Stacks of one shape merged pixel by pixel; a union and one aggregation, however many there are."""
    kinds: dict[str, Callable] = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    out = frames[0].select(*keys, "row", "col", "val")
    for f in frames[1:]:
        out = out.unionByName(f.select(*keys, "row", "col", "val"))
    return out.groupBy(*keys, "row", "col").agg(kinds[how]("val").alias("val"))


def dilate(df: DataFrame, keys: list[str], reach: int = 2) -> DataFrame:
    """Greatest value within reach, at pixels that exist: each pixel sends its value to its neighbours, and partial maxima combine before the shuffle."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = df.select(*keys, F.col("row").alias("_r"), F.col("col").alias("_c"), "val", F.explode(steps).alias("_dr")).select("*", F.explode(steps).alias("_dc"))
    most = sent.groupBy(*keys, (F.col("_r") + F.col("_dr")).alias("row"), (F.col("_c") + F.col("_dc")).alias("col")).agg(F.max("val").alias("dilated"))
    return df.join(most, [*keys, "row", "col"])


def boundary(df: DataFrame, keys: list[str], t: float) -> DataFrame:
    """Pixels of at least t with one of eight neighbours under t; absent neighbours count as none."""
    steps = F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    low = df.where(F.col("val") < t).select(*keys, "row", "col", F.explode(steps).alias("_s"))
    near = low.select(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col")).distinct()
    return df.where(F.col("val") >= t).join(near, [*keys, "row", "col"], "left_semi")


def resample(df: DataFrame, keys: list[str], rows: int, cols: int, new_rows: int, new_cols: int) -> DataFrame:
    """Bilinear resampling to another grid; absent pixels count 0. Each source pixel is joined by its place, four for each target pixel."""
    images = df.select(*keys).distinct()
    grid = images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(new_rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(new_cols - 1))).alias("col"))
    y = F.col("row") * ((rows - 1) / max(1, new_rows - 1))
    x = F.col("col") * ((cols - 1) / max(1, new_cols - 1))
    corners = []
    for dy in (0, 1):
        for dx in (0, 1):
            r, c = F.floor(y), F.floor(x)
            wy, wx = (y - r) if dy else (1 - (y - r)), (x - c) if dx else (1 - (x - c))
            corners.append(F.struct((r + dy).cast("bigint").alias("r"), (c + dx).cast("bigint").alias("c"), (wy * wx).alias("w")))
    wide = grid.withColumn("_k", F.explode(F.array(*corners))).where("_k.w > 0").select(*keys, "row", "col", F.col("_k.r").alias("_r"), F.col("_k.c").alias("_c"), F.col("_k.w").alias("_w"))
    source = df.select(*keys, F.col("row").cast("bigint").alias("_r"), F.col("col").cast("bigint").alias("_c"), "val")
    joined = wide.join(source, [*keys, "_r", "_c"], "left")
    return joined.groupBy(*keys, "row", "col").agg(F.sum(F.coalesce("val", F.lit(0.0)) * F.col("_w")).alias("val"))


def swap_axes(df: DataFrame, flip_rows: int | None = None) -> DataFrame:
    """Rows and columns exchanged; rows reversed among so many if given."""
    row = F.col("col") if flip_rows is None else flip_rows - 1 - F.col("col")
    return df.withColumns({"row": row, "col": F.col("row")})


def image_range(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, imgmin, imgmax, rows, cols) of images."""
    return df.groupBy(*keys).agg(F.min("val").alias("imgmin"), F.max("val").alias("imgmax"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
