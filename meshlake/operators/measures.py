"""Measures of regions and objects over time, and fields and companions of datasets by name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from . import agg


def displacements(nodes: DataFrame, time: str, keys: list[str], k: float = 1.0) -> DataFrame:
    """(keys, time, trimmed_mean, n_kept): the trimmed mean of how far a region's nodes have moved from their first place. nodes: (keys, node_id, time, p); a node counts once a region and time."""
    distinct = nodes.groupBy(*keys, "node_id", time).agg(F.min("p").alias("p"))
    first = distinct.groupBy(*keys, "node_id").agg(F.min_by("p", time).alias("_p0"))
    moved = distinct.join(first, [*keys, "node_id"]).withColumn("_d", vec.distance(F.col("p"), F.col("_p0")))
    return agg.trimmed_mean(moved, [*keys, time], "_d", k)


def wall_thickness(hits: DataFrame, keys: list[str], tri: str, distance: str, k: float = 1.0) -> DataFrame:
    """(keys, trimmed_mean, n_kept) of the distances to the first wall that rays from triangles meet. hits: (keys, tri, distance)."""
    nearest = hits.where(F.col(distance) > 0).groupBy(*keys, tri).agg(F.min(distance).alias("_d"))
    return agg.trimmed_mean(nearest, keys, "_d", k)


def percent_range(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, least, most) of a value in percent of that at the key's first time."""
    percent = agg.ratio_to_first(df, key, time, value).withColumn("_percent", F.col("ratio") * 100)
    return percent.groupBy(key).agg(F.min("_percent").alias("least"), F.max("_percent").alias("most"))


def latest_maximum(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """(keys, value, at): the greatest value and its time, the latest of equal ones."""
    best = df.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), F.col(time).alias("t"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(value), F.col("_b.t").alias("at"))


def line_lengths(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length): the distance of the first two points of a measurement. points: (keys, at, p)."""
    ends = points.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "p"))), 1, 2).alias("_ends"))
    return ends.select(*keys, vec.distance(F.get("_ends", 0)["p"], F.get("_ends", 1)["p"]).alias("length"))


def smoothed(df: DataFrame, order: str, value: str, sigma: float) -> DataFrame:
    """df with `smooth`: values weighted by a normal curve over their neighbours in an order of whole numbers; sums of weights are kept at the ends. Rows are the bins of a histogram."""
    reach = max(1, math.ceil(4 * sigma))
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(math.exp(-k * k / (2 * sigma * sigma))).alias("w")) for k in range(-reach, reach + 1)))
    sent = df.select(F.col(order).alias("_o"), F.col(value).alias("_v"), F.explode(steps).alias("_s")).select((F.col("_o") + F.col("_s.k")).alias(order), (F.col("_v") * F.col("_s.w")).alias("_x"), F.col("_s.w").alias("_w"))
    sums = sent.groupBy(order).agg((F.sum("_x") / F.sum("_w")).alias("smooth"))
    return df.join(sums, order)


def histogram_extrema(histogram: DataFrame, order: str = "bin", value: str = "n", sigma: float = 3.0, reach: int = 5, filtered: bool = True) -> DataFrame:
    """(order, value, kind): the maxima and minima of a histogram, one row for each bin from its first to its last.

    The first bin that holds something is set to 0 and counts as a minimum; the rest is smoothed by a normal curve with
    mirrored ends, and a bin is an extreme if its smoothed value is beyond those of `reach` bins on either side. Filtered,
    a maximum stays if it is by half the mean count over the nearest minimum before it, or by as much under the nearest one
    behind it, and a minimum if it is beside such a maximum. Rows are bins, so windows without keys are small."""
    first = histogram.where(F.col(value) > 0).agg(F.min(order).alias("_first"))
    ends = histogram.agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    bins = histogram.crossJoin(F.broadcast(first)).crossJoin(F.broadcast(ends))  # one row each
    bins = bins.withColumn("_v", F.when(F.col(order) == F.col("_first"), 0.0).otherwise(F.col(value).cast("double")))
    n = F.col("_high") - F.col("_low") + 1
    wide = max(1, int(4 * sigma + 0.5))
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-wide, wide + 1)]
    steps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w / sum(weights)).alias("w")) for k, w in zip(range(-wide, wide + 1), weights)))
    # Each bin asks for its neighbours; places beyond an end are mirrored, the end itself twice.
    asked = bins.select(F.col(order).alias("_to"), n.alias("_n"), "_low", F.explode(steps).alias("_s"))
    place = F.pmod(F.col("_to") - F.col("_low") + F.col("_s.k"), 2 * F.col("_n"))
    asked = asked.select("_to", F.col("_s.w").alias("_w"), (F.least(place, 2 * F.col("_n") - 1 - place) + F.col("_low")).alias(order))
    smooth = asked.join(bins.select(order, "_v"), order).groupBy(F.col("_to").alias(order)).agg(F.sum(F.col("_w") * F.col("_v")).alias("_smooth"))
    bins = bins.join(smooth, order)
    w = Window.orderBy(order)
    near = lambda f: f(*(g("_smooth", k).over(w) for k in range(1, reach + 1) for g in (F.lag, F.lead)))
    # Near an end a bin is compared with those that are there; an end is no extreme.
    inner = (F.col(order) > F.col("_low")) & (F.col(order) < F.col("_high"))
    kind = F.when(inner & (F.col("_smooth") > near(F.greatest)), "max").when(inner & (F.col("_smooth") < near(F.least)), "min")
    found = bins.withColumn("kind", F.when(F.col(order) == F.col("_first"), "min").otherwise(kind))
    mean = found.agg((F.avg("_v") * 0.5).alias("_limit"))
    found = found.where("kind is not null").crossJoin(F.broadcast(mean))  # one row
    if filtered:
        least = F.when(F.col("kind") == "min", F.struct(F.col(order).alias("o"), F.col("_v").alias("v")))
        before = F.last(least, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        behind = F.first(least, True).over(w.rowsBetween(1, Window.unboundedFollowing))
        found = found.withColumns({"_l": before, "_r": behind})
        stays = (F.col("kind") == "max") & (F.coalesce(F.col("_v") - F.col("_l.v") > F.col("_limit"), F.lit(False)) | F.coalesce(F.col("_r.v") - F.col("_v") > F.col("_limit"), F.lit(False)))
        found = found.withColumns({"_stays": stays, "_run": F.sum((F.col("kind") == "min").cast("int")).over(w)})
        # Maxima between two minima are beside both of them.
        kept = found.groupBy("_run").agg(F.bool_or("_stays").alias("_kept")).where("_kept")
        beside = kept.select(F.explode(F.array("_run", F.col("_run") + 1)).alias("_run")).distinct().withColumn("_beside", F.lit(True))
        found = found.join(beside, "_run", "left").where(F.col("_stays") | ((F.col("kind") == "min") & F.col("_beside")))
    return found.select(order, F.col("_v").alias(value), "kind")


def is_ct(histogram: DataFrame, order: str = "bin", value: str = "n", sigma: float = 3.0, least: int = 3) -> DataFrame:
    """(is_ct): whether a histogram has more than `least` maxima, as `histogram_extrema` finds and filters them."""
    peaks = histogram_extrema(histogram, order, value, sigma).where("kind = 'max'")
    return peaks.agg((F.count("*") > least).alias("is_ct"))


# Datasets: catalogue rows (dataset, name, kind, meta) of index sets and fields.


def companions(catalogue: DataFrame, suffixes: dict[str, str]) -> DataFrame:
    """Spatial index sets with the names of their companions, which have the set's name and a suffix; null where there is none."""
    out = catalogue.where("kind = 'spatial'").select("dataset", "name")
    for column, suffix in suffixes.items():
        other = catalogue.select(F.col("dataset").alias("_of"), F.col("name").alias(column))
        out = out.join(other, (F.col("dataset") == F.col("_of")) & (F.concat("name", F.lit(suffix)) == F.col(column)), "left").drop("_of")
    return out


def field_topologies(fields: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(dataset, field, spatial, topology): a field's spatial index set and its own one, which is the spatial one if it names none; fields with an unknown set are dropped. fields: (dataset, field, spatial, topology)."""
    sets = catalogue.select("dataset", F.col("name").alias("_set"))
    named = fields.withColumn("topology", F.coalesce("topology", "spatial"))
    for c in ("spatial", "topology"):
        named = named.join(sets, (named["dataset"] == sets["dataset"]) & (named[c] == sets["_set"]), "left_semi")
    return named


def is_spatial(kind: Column, width: Column, dims: Column, dim: int | None = None) -> Column:
    """Whether an index set holds elements in space, and of so many dimensions if given."""
    found = (kind == "spatial") & (width > 1)
    return found if dim is None else found & (dims == dim)


def field_list(fields: DataFrame) -> DataFrame:
    """(dataset, n_fields, names, first_ts, last_ts) over time steps."""
    return fields.groupBy("dataset").agg(F.count("*").alias("n_fields"), F.array_sort(F.collect_set("name")).alias("names"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
