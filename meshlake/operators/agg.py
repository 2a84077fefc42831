"""Aggregations by region and timestep, histograms and trimmed means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec


def region_sum(df: DataFrame, region: str, value: str, chosen: list | None = None, keys: list[str] | None = None) -> DataFrame:
    """Sum of a value by region (and further keys), only for chosen regions if given."""
    rows = df.where(F.col(region).isin(chosen)) if chosen else df
    return rows.groupBy(*(keys or []), region).agg(F.sum(value).alias("total"))


def spread_region_sum(df: DataFrame, region: str, value: str, chosen: list, out: str = "total") -> DataFrame:
    """Each row with its region's sum; 0 outside the chosen regions. The sums are one row per region."""
    sums = region_sum(df, region, value, chosen).withColumnRenamed("total", out)
    return df.join(sums, region, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def ratio_to_first(df: DataFrame, key: str, time: str, value: str, out: str = "ratio") -> DataFrame:
    """A value over that of the key's first time; 0 where that is 0."""
    first = F.first(value).over(Window.partitionBy(key).orderBy(time))
    return df.withColumn(out, F.when(first == 0, 0.0).otherwise(F.col(value) / F.when(first != 0, first)))


def volume_summary(df: DataFrame, region: str, time: str, value: str) -> DataFrame:
    """(esv, edv, stroke, ef, sdi) of totals by time, and the spread of the regions' times of minimum (the earliest of equal ones)."""
    totals = df.groupBy(time).agg(F.sum(value).alias("v"))
    ends = totals.agg(F.min("v").alias("esv"), F.max("v").alias("edv"))
    least = df.groupBy(region).agg(F.min(F.struct(F.col(value).alias("v"), F.col(time).alias("t")))["t"].alias("t"))
    sdi = least.agg(F.coalesce(F.stddev_samp("t"), F.lit(0.0)).alias("sdi"))
    both = ends.crossJoin(F.broadcast(sdi))  # one row each
    stroke = F.col("edv") - F.col("esv")
    return both.select("esv", "edv", stroke.alias("stroke"), F.when(F.col("edv") == 0, 0.0).otherwise(stroke * 100 / F.col("edv")).alias("ef"), "sdi")


def exact_mean(value: str) -> Column:
    """The mean with all its digits down to 1e-18, whatever order rows come in; where a value or the sum is 1e20 or more, or no number, the usual one."""
    whole = F.col(value).try_cast("decimal(38,18)")
    return F.coalesce(F.when(F.count(whole) == F.count(value), F.try_avg(whole)).cast("double"), F.avg(value))


def trimmed_mean(df: DataFrame, keys: list[str], value: str, k: float = 1.0) -> DataFrame:
    """Mean of the values within k sample deviations of the mean. Two aggregations instead of a window, so that a large group is never in one task."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("_s"))
    kept = df.join(stats, keys).where(F.abs(F.col(value) - F.col("_m")) <= k * F.col("_s"))
    return kept.groupBy(*keys).agg(F.avg(value).alias("trimmed_mean"), F.count("*").alias("n_kept"))


def histogram(df: DataFrame, value: str, low: int, bins: int) -> DataFrame:
    """(bin, n) for every bin from 0: value rounded half up to an integer, less low; values outside are dropped."""
    at = F.floor(F.col(value) + 0.5) - low
    counts = df.select(at.alias("bin")).where(F.col("bin").between(0, bins - 1)).groupBy("bin").agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def extrema(df: DataFrame, order: str, value: str) -> DataFrame:
    """Rows with kind max or min where both neighbours in order are smaller or larger. The frame has one row per bin."""
    w = Window.orderBy(order)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    kind = F.when((F.col(value) > before) & (F.col(value) > after), "max").when((F.col(value) < before) & (F.col(value) < after), "min")
    return df.withColumn("kind", kind).where("kind is not null")


def aabb(df: DataFrame, keys: list[str], p: Column) -> DataFrame:
    """Bounding box of points by key: corners, center and radius."""
    ends = df.groupBy(*keys).agg(*(f(p[c]).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))
    mid = {f"center_{c}": (F.col(f"min_{c}") + F.col(f"max_{c}")) / 2 for c in "xyz"}
    half = F.sqrt(sum(((F.col(f"max_{c}") - F.col(f"min_{c}")) / 2) ** 2 for c in "xyz"))
    return ends.withColumns(mid | {"radius": half})


def statistics(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Mean, sample deviation (0 for one row), norm, mean gap and the places of least and greatest value."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"), F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm"),
        F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("o")))["o"].alias("argmin"),
        F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("o")))["o"].alias("_m"),
    ).withColumn("argmax", -F.col("_m")).drop("_m")


def upsert_latest(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(*keys).agg(F.max(F.struct(*order, F.col(value).alias("_v")))["_v"].alias(value))


def check_index(elements: DataFrame, ids: str, n_nodes: int, width: int) -> DataFrame:
    """Counts of rows that break the rules of an index: out of range, of another width, or with nulls."""
    bad = {"out_of_range": F.exists(ids, lambda v: (v < 0) | (v >= n_nodes)), "wrong_width": F.size(ids) != width, "has_null": F.exists(ids, lambda v: v.isNull())}
    return elements.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in bad.items()))


def torsion(df: DataFrame, keys: list[str], length: float) -> DataFrame:
    """Mean twist of the apex less that of the base, and the same by length. df: (keys, is_apex, twist)."""
    means = df.groupBy(*keys).agg(F.avg(F.when(F.col("is_apex"), F.col("twist"))).alias("_a"), F.avg(F.when(~F.col("is_apex"), F.col("twist"))).alias("_b"))
    twist = F.col("_a") - F.col("_b")
    return means.select(*keys, twist.alias("twist"), (twist / length).alias("torsion"))


def mean_by_region(df: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.avg(c).alias(k) for k, c in values.items()))


def centered(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Points less the centre of their keys' bounding box."""
    boxes = aabb(df, keys, F.col(p)).select(*keys, *(f"center_{c}" for c in "xyz"))
    center = vec.vec(*(F.col(f"center_{c}") for c in "xyz"))
    return df.join(boxes, keys).withColumn(p, vec.sub(F.col(p), center)).drop("center_x", "center_y", "center_z")


def unit_scaled(df: DataFrame, value: str, missing: Column, out: str = "unit") -> DataFrame:
    """Values from 0 to 1; the scale begins a hundredth of the range below the least value, and rows without data are 0."""
    ends = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    low = F.col("_a") - 0.01 * (F.col("_b") - F.col("_a"))
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(value) - low) / F.nullif(F.col("_b") - low, F.lit(0.0))))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, F.when(missing, 0.0).otherwise(F.coalesce(unit, F.lit(0.0)))).drop("_a", "_b")  # one row


def min_max(df: DataFrame, keys: list[str], value: str, low: str = "min_val", high: str = "max_val") -> DataFrame:
    """The least and the greatest value of each key."""
    return df.groupBy(*keys).agg(F.min(value).alias(low), F.max(value).alias(high))


def union_range(frames: list[tuple[DataFrame, str]]) -> DataFrame:
    """(min_val, max_val) over the values of several frames, each aggregated before they meet."""
    ends = [min_max(df, [], value) for df, value in frames]
    whole = ends[0]
    for e in ends[1:]:
        whole = whole.unionByName(e)
    return whole.agg(F.min("min_val").alias("min_val"), F.max("max_val").alias("max_val"))


def profile(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n, m): rows and columns of frames."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(len(df.columns)).alias("m")) for name, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def energy(df: DataFrame, keys: list[str], components: list[str], weight: float) -> DataFrame:
    """(keys, energy): sums of squares of components, times a weight."""
    square = sum((F.col(c) ** 2 for c in components[1:]), F.col(components[0]) ** 2)
    return df.groupBy(*keys).agg(F.sum(square * float(weight)).alias("energy"))


def pivot_series(df: DataFrame, key: str, series: str, names: list[str], value: str) -> DataFrame:
    """(key, one column a series): sums of values, 0 where there are none; the names are given, so no pass looks for them."""
    wide = df.groupBy(key).pivot(series, names).agg(F.sum(value))
    return wide.select(key, *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))


#: Bottoms of the rings of heart segments as shares of the height, and the number of sectors of each.
RINGS = ((1 / 3, 6), (2 / 3, 6), (1.0, 4))


def heart_segment(height: Column, turn: Column, apex: float = 1.0, with_apex: bool = True) -> Column:
    """The segment from 1 to 18 at a relative height (0 at the base, under 0 above it) and a turn from 0 to 1.

    Rings of six start at their second segment; the ring of four is turned by 5 / 24. Segment 18 lies above the base, 17 is the apex."""
    sixth = lambda first: first + (F.least(F.greatest(F.floor(turn * 6), F.lit(0)), F.lit(5)) + 1) % 6
    quarter = 13 + F.floor(turn * 4 + 5 / 6) % 4
    out = F.when(height < 0, 18).when(height < apex * RINGS[0][0], sixth(1)).when(height < apex * RINGS[1][0], sixth(7))
    return (out.when(height < apex * RINGS[2][0], quarter).otherwise(17) if with_apex else out.otherwise(quarter)).cast("bigint")


def cavity_segment(turn: Column) -> Column:
    """The segment of a cavity from 18 to 23 at a turn from 0 to 1."""
    return (18 + F.least(F.greatest(F.floor(turn * 6), F.lit(0)), F.lit(5))).cast("bigint")
