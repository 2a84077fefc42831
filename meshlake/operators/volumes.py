"""Image volumes and contours: sampling, masks, connected objects, motion, and contour geometry.

Pixels are rows (keys, row, col, val), contour points rows (keys, at, p) in the order of `at`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, vec
from .stored import stored


def hounsfield_unit(h: Column, low: float, high: float) -> Column:
    """From 0 at low to 1 at high, clamped."""
    return scalars.clamp(scalars.lerp_xi(h, low, high), 0.0, 1.0)


def nan_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n) of values that are no number; a check passes if all are 0."""
    counts = df.agg(*(F.count_if(F.isnan(c)).alias(c) for c in columns))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns))).alias("c")).select("c.*")


def sample_ray(df: DataFrame, keys: list[str], start: tuple[float, float], step: tuple[float, float], n: int, rows: int, cols: int) -> DataFrame:
    """(keys, k, val): the nearest pixel at each of n places from start; ends at the first place outside the image."""
    places = []
    for k in range(n):
        r, c = math.floor(start[0] + k * step[0] + 0.5), math.floor(start[1] + k * step[1] + 0.5)
        if not (0 <= r < rows and 0 <= c < cols):
            break
        places.append((k, r, c))
    samples = df.sparkSession.createDataFrame(places, "k int, row int, col int")
    wide = df.select(*keys).distinct().crossJoin(F.broadcast(samples))  # at most n places
    return wide.join(df, [*keys, "row", "col"], "left").select(*keys, "k", F.coalesce("val", F.lit(0.0)).alias("val"))


def is_volume(images: DataFrame, key: str, order: str, err: float = 1e-3) -> DataFrame:
    """(key, is_volume): positions on one line, and equal normals and diagonals. images: (key, order, pos, normal, diagonal)."""
    ends = images.groupBy(key).agg(F.min_by(F.struct("pos", "normal", "diagonal"), order).alias("_a"), F.max_by("pos", order).alias("_b"))
    joined = images.join(ends, key).withColumn("_line", vec.norm(vec.sub(F.col("_b"), F.col("_a.pos"))))
    off = vec.length(vec.cross(vec.sub(F.col("pos"), F.col("_a.pos")), F.col("_line")))
    fine = (off <= err) & (vec.distance(F.col("normal"), F.col("_a.normal")) <= err) & (vec.distance(F.col("diagonal"), F.col("_a.diagonal")) <= err)
    return joined.groupBy(key).agg(F.bool_and(fine).alias("is_volume"))


def voxel_depth(images: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, depth): the least distance between neighbouring different slices, 0 for one slice."""
    slices = images.select(*keys, at).distinct()
    gap = F.lead(at).over(Window.partitionBy(*keys).orderBy(at)) - F.col(at)
    return slices.withColumn("_gap", gap).groupBy(*keys).agg(F.coalesce(F.min("_gap"), F.lit(0.0)).alias("depth"))


def respaced_grid(images: DataFrame, keys: list[str], rows: int, cols: int, spacing: float, new: float) -> DataFrame:
    """(keys, row, col, y, x): the cells of a grid over the same space with another spacing, and their places in the old one."""
    n = lambda k: max(1, math.ceil(k * spacing / new - 1e-9))
    grid = images.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n(rows) - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n(cols) - 1))).alias("col"))
    place = lambda c: (F.col(c) + 0.5) * (new / spacing) - 0.5
    return grid.withColumns({"y": place("row"), "x": place("col")})


def shift(df: DataFrame, shifts: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Pixels moved by whole steps (keys, dr, dc); what leaves the image is dropped."""
    moved = df.join(shifts, keys).select(*keys, (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "val")
    return moved.where(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1))


def sample_stack(points: DataFrame, stack: DataFrame, rows: int, cols: int, slices: int, keys: list[str] | None = None) -> DataFrame:
    """(id, val): trilinear samples at points (id, x, y, z) of the unit cube; outside 0. stack: (slice, row, col, val), absent pixels count 0.

    Each point meets its eight pixels by their place; with one slice this is bilinear. With keys, points and stacks have them and meet within them."""
    keys = keys or []
    inside = F.col("x").between(0, 1) & F.col("y").between(0, 1) & F.col("z").between(0, 1)
    at = {"row": F.col("y") * (rows - 1), "col": F.col("x") * (cols - 1), "slice": F.col("z") * (slices - 1)}
    corners = []
    for k in range(8):
        parts, weight = [], F.lit(1.0)
        for j, (name, c) in enumerate(at.items()):
            up = k >> j & 1
            share = c - F.floor(c)
            weight = weight * (share if up else 1.0 - share)
            parts.append((F.floor(c) + up).cast("bigint").alias(name))
        corners.append(F.struct(*parts, weight.alias("w")))
    wide = points.where(inside).select(*keys, "id", F.explode(F.array(*corners)).alias("c")).where("c.w > 0").select(*keys, "id", "c.*")
    cells = stack.select(*keys, *(F.col(c).cast("bigint").alias(c) for c in ("row", "col", "slice")), "val")
    sums = wide.join(cells, [*keys, "row", "col", "slice"], "left").groupBy(*keys, "id").agg(F.sum(F.col("w") * F.coalesce("val", F.lit(0.0))).alias("val"))
    return points.select(*keys, "id").join(sums, [*keys, "id"], "left").select(*keys, "id", F.coalesce("val", F.lit(0.0)).alias("val"))


def resample_volume(df: DataFrame, keys: list[str], shape: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """(keys, slice, row, col, val): volumes of a shape (slices, rows, cols) on another grid over the same space, ends on ends; absent pixels count 0."""
    names = ("slice", "row", "col")
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    for c, n in zip(names, new):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    place = [F.col(c) / float(max(1, n - 1)) for c, n in zip(names, new)]
    asked = grid.select(*keys, F.struct(*names).alias("id"), place[2].alias("x"), place[1].alias("y"), place[0].alias("z"))
    found = sample_stack(asked, df, shape[1], shape[2], shape[0], keys)
    return found.select(*keys, "id.*", "val")


def merge_volumes(frames: list[tuple[DataFrame, tuple[int, int, int]]], keys: list[str], new: tuple[int, int, int], how: str = "max") -> DataFrame:
    """Volumes (frame, shape) of several shapes resampled to one grid and merged voxel by voxel: a union and one aggregation."""
    kinds = {"max": F.max, "min": F.min, "avg": F.avg, "sum": F.sum}
    parts = [resample_volume(df, keys, shape, new) for df, shape in frames]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys, "slice", "row", "col").agg(kinds[how]("val").alias("val"))


def dilate_volume(df: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Greatest value within reach along slices, rows and columns, at pixels that exist; one axis after another, so 3 (2 reach + 1) rows a pixel move, not (2 reach + 1)³."""
    out = df
    for axis in ("slice", "row", "col"):
        others = [c for c in ("slice", "row", "col") if c != axis]
        sent = out.select(*keys, *others, (F.explode(F.sequence(F.col(axis) - reach, F.col(axis) + reach))).alias(axis), "val")
        out = sent.groupBy(*keys, "slice", "row", "col").agg(F.max("val").alias("val"))
    return df.join(out.withColumnRenamed("val", "dilated"), [*keys, "slice", "row", "col"])


def erode(mask: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """Pixels (keys, row, col) of a mask whose whole neighbourhood lies in it."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    sent = mask.select(*keys, "row", "col", F.explode(steps).alias("_r")).select("*", F.explode(steps).alias("_c"))
    near = sent.groupBy(*keys, (F.col("row") + F.col("_r")).alias("row"), (F.col("col") + F.col("_c")).alias("col")).agg(F.count("*").alias("_n"))
    return near.where(F.col("_n") == (2 * reach + 1) ** 2).select(*keys, "row", "col")


def objects(mask: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """mask (keys, row, col) with `object`, the least pixel number of its connected object.

    Rows' runs come first, so that a round goes over runs, not pixels; each round takes the least number of touching runs, and then that of the run with this number, until nothing changes."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    runs = mask.select(*keys, "row", "col").withColumn("_run", F.col("col") - F.row_number().over(w))
    runs = runs.groupBy(*keys, "row", "_run").agg(F.min("col").alias("_a"), F.max("col").alias("_b"))
    runs = stored(runs.withColumn("_id", F.col("row").cast("bigint") * (1 << 31) + F.col("_a")).withColumn("_least", F.col("_id")))
    reach = 1 if diagonal else 0
    other = runs.select(*keys, (F.col("row") + 1).alias("row"), F.col("_a").alias("_c"), F.col("_b").alias("_d"), F.col("_id").alias("_to"))
    touching = runs.select(*keys, "row", "_a", "_b", "_id").join(other, [*keys, "row"]).where((F.col("_a") <= F.col("_d") + reach) & (F.col("_c") <= F.col("_b") + reach))
    links = touching.select(*keys, "_id", "_to")
    links = stored(links.unionByName(links.select(*keys, F.col("_to").alias("_id"), F.col("_id").alias("_to"))))
    while True:
        label = runs.select(*keys, F.col("_id").alias("_to"), F.col("_least").alias("_other"))
        near = links.join(label, [*keys, "_to"]).groupBy(*keys, "_id").agg(F.min("_other").alias("_near"))
        step = runs.join(near, [*keys, "_id"], "left").withColumn("_new", F.least("_least", F.coalesce("_near", "_least")))
        jump = runs.select(*keys, F.col("_id").alias("_new"), F.col("_least").alias("_far"))
        new = stored(step.join(jump, [*keys, "_new"], "left").withColumn("_new", F.least("_new", F.coalesce("_far", "_new"))).select(*keys, "row", "_run", "_a", "_b", "_id", F.col("_new").alias("_least"), (F.col("_new") != F.col("_least")).alias("_moved")))
        runs = new.drop("_moved")
        if new.where("_moved").isEmpty():
            break
    return runs.select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col"), F.col("_least").alias("object"))


def largest_object(mask: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """Pixels of the object with the most pixels of each image, the first one of equal ones."""
    found = stored(objects(mask, keys, diagonal))
    sizes = found.groupBy(*keys, "object").agg(F.count("*").alias("_n"))
    best = sizes.groupBy(*keys).agg(F.min(F.struct(-F.col("_n"), F.col("object").alias("object")))["object"].alias("object"))
    return found.join(best, [*keys, "object"]).select(*keys, "row", "col")


def holes(mask: DataFrame, keys: list[str], rows: int, cols: int) -> DataFrame:
    """Pixels outside a mask from which no way of four neighbours leads to the image's edge."""
    grid = mask.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))).alias("col"))
    found = stored(objects(grid.join(mask, [*keys, "row", "col"], "left_anti"), keys))
    edge = F.col("row").isin(0, rows - 1) | F.col("col").isin(0, cols - 1)
    outside = found.where(edge).select(*keys, "object").distinct()
    return found.join(outside, [*keys, "object"], "left_anti").select(*keys, "row", "col")


def mask_volume(df: DataFrame, keys: list[str], voxel: float) -> DataFrame:
    """(keys, volume): the pixels that have their image's greatest value, times the volume of a voxel."""
    most = df.groupBy(*keys, "val").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.max_by("_n", "val").alias("_n"))
    return most.select(*keys, (F.col("_n") * float(voxel)).alias("volume"))


def over_percentile(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Rows of at least their keys' percentile."""
    limits = df.groupBy(*keys).agg(F.percentile(value, share).alias("_p"))
    return df.join(limits, keys).where(F.col(value) >= F.col("_p")).drop("_p")


def image_stack(spark: SparkSession, width: int, height: int, slices: int, steps: int = 1, interval: float = 1.0, start: float = 0.0) -> DataFrame:
    """(image_id, slice, step, ts, row, col) of an image object: slices vary before steps, ts = start + step × interval."""
    i = F.col("id")
    image = F.floor(i / (width * height))
    step = F.floor(image / slices)
    return spark.range(width * height * slices * steps).select(image.alias("image_id"), (image % slices).alias("slice"), step.alias("step"), (start + step * float(interval)).alias("ts"), (F.floor(i / width) % height).alias("row"), (i % width).alias("col"))


def image_stacks(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, image_id, slice, step, ts, row, col) of a generated image object for each row of (keys, width, height, slices, steps, start, interval), numbered as by `image_stack`."""
    count = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c).cast("bigint") - 1))
    wide = objects.withColumn("step", count("steps")).withColumn("slice", count("slices")).withColumn("row", count("height")).withColumn("col", count("width"))
    return wide.select(*keys, (F.col("step") * F.col("slices") + F.col("slice")).alias("image_id"), "slice", "step", (F.col("start") + F.col("step") * F.col("interval")).alias("ts"), "row", "col")


def from_flat(df: DataFrame, keys: list[str], values: str, shape: tuple[int, int, int, int], interval: float = 1.0, start: float = 0.0) -> DataFrame:
    """Flat arrays, x fastest, of a 4-D shape (x, y, z, t) as pixels of image objects: (keys, image_id, slice, step, ts, row, col, val)."""
    width, height, slices, _ = shape
    wide = df.select(*keys, F.posexplode(values).alias("_i", "val"))
    i = F.col("_i").cast("bigint")
    image = F.floor(i / (width * height))
    step = F.floor(image / slices)
    return wide.select(*keys, image.alias("image_id"), (image % slices).alias("slice"), step.alias("step"), (start + step * float(interval)).alias("ts"), (F.floor(i / width) % height).alias("row"), (i % width).alias("col"), F.col("val").cast("double").alias("val"))


def ellipsoid(stack: DataFrame, center: tuple, radii: tuple, shell: float = 0.1) -> DataFrame:
    """stack with val 1 in the shell of an ellipsoid (col, row, slice), 0 elsewhere."""
    d = F.sqrt(sum(((F.col(c) - float(m)) / float(r)) ** 2 for c, m, r in zip(("col", "row", "slice"), center, radii)))
    return stack.withColumn("val", F.when(F.abs(d - 1) <= shell, 1.0).otherwise(0.0))


def from_array(spark: SparkSession, shape: tuple[int, int, int, int], value, interval: float = 1.0, start: float = 0.0) -> DataFrame:
    """A 4-D array (x, y, z, t), given as a function of its index columns, as pixels of an image object."""
    stack = image_stack(spark, shape[0], shape[1], shape[2], shape[3], interval, start)
    return stack.withColumn("val", value(F.col("col"), F.col("row"), F.col("slice"), F.col("step")))


# Contours


def closed_pairs(points: DataFrame, keys: list[str]) -> DataFrame:
    """Points with `q`, the next one of their contour; the first follows the last."""
    w = Window.partitionBy(*keys).orderBy("at")
    first = F.first("p").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return points.withColumn("q", F.coalesce(F.lead("p").over(w), first))


def contour_planes(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, center, normal, area, length) of closed contours: the normal and the area come from the sum of the edges' cross products."""
    pairs = closed_pairs(points, keys).withColumn("_c", vec.cross(F.col("p"), F.col("q")))
    sums = pairs.groupBy(*keys).agg(*(F.avg(f"p.{c}").alias(f"_m{c}") for c in "xyz"), *(F.sum(f"_c.{c}").alias(f"_n{c}") for c in "xyz"), F.sum(vec.distance(F.col("p"), F.col("q"))).alias("length"))
    n = vec.vec(*(F.col(f"_n{c}") for c in "xyz"))
    return sums.select(*keys, vec.vec(*(F.col(f"_m{c}") for c in "xyz")).alias("center"), vec.norm(n).alias("normal"), (vec.length(n) / 2).alias("area"), "length")


def resample_contour(points: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, k, p): n points at equal distances along closed contours; each edge gives the points that fall on it."""
    pairs = closed_pairs(points, keys).withColumn("_d", vec.distance(F.col("p"), F.col("q")))
    w = Window.partitionBy(*keys).orderBy("at")
    total = F.sum("_d").over(Window.partitionBy(*keys))
    pairs = pairs.withColumns({"_from": F.sum("_d").over(w) - F.col("_d"), "_all": total})
    unit = F.col("_all") / n
    first, last = F.ceil(F.col("_from") / unit - 1e-9), F.ceil((F.col("_from") + F.col("_d")) / unit - 1e-9) - 1
    hits = pairs.where(F.col("_d") > 0).withColumn("k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    t = (F.col("k") * unit - F.col("_from")) / F.col("_d")
    return hits.where(F.col("k") < n).withColumn("_t", F.greatest(F.lit(0.0), t)).select(*keys, "k", vec.lerp(F.col("p"), F.col("q"), F.col("_t")).alias("p"))


def iso_triangles(tets: DataFrame, iso: float) -> DataFrame:
    """(elem_id, part, a, b, c): the triangles at which a value of tetrahedra is iso. tets: (elem_id, corners: four structs of val and p).

    Corners are sorted by value; with one or three above the value three edges cross it, with two above four do."""
    s = F.reverse(F.array_sort("corners"))
    tets = tets.withColumn("_s", s)
    corner = lambda k: F.get("_s", k)

    def cut(i: int, j: int) -> Column:
        a, b = corner(i), corner(j)
        return vec.lerp(a["p"], b["p"], (a["val"] - iso) / F.nullif(a["val"] - b["val"], F.lit(0.0)))

    above = F.size(F.filter("_s", lambda c: c["val"] > iso))
    triangle = lambda *edges: F.struct(*(cut(*e).alias(k) for k, e in zip("abc", edges)))
    one, three = triangle((0, 1), (0, 2), (0, 3)), triangle((0, 3), (1, 3), (2, 3))
    two = F.array(triangle((0, 2), (0, 3), (1, 3)), triangle((0, 2), (1, 3), (1, 2)))
    found = F.when(above == 1, F.array(one)).when(above == 2, two).when(above == 3, F.array(three))
    return tets.withColumn("_found", found).where("_found is not null").select("elem_id", F.posexplode("_found").alias("part", "t")).select("elem_id", "part", "t.*")


def slice_triangles(tets: DataFrame, at: Column, normal: Column) -> DataFrame:
    """The same for a plane: tets (elem_id, corners: four points)."""
    valued = F.transform("corners", lambda p: F.struct(vec.plane_distance(p, at, normal).alias("val"), p.alias("p")))
    return iso_triangles(tets.withColumn("corners", valued), 0.0)


def mask_edges(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, dr, dc): the sides of a mask's pixels beyond which there is none of it: the contours of its objects and of their holes."""
    sides = F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1))))
    wide = mask.select(*keys, "row", "col", F.explode(sides).alias("_s")).select(*keys, "row", "col", "_s.*")
    wide = wide.withColumns({"_r": F.col("row") + F.col("dr"), "_c": F.col("col") + F.col("dc")})
    other = mask.select(*(F.col(k).alias(f"_o_{k}") for k in keys), F.col("row").alias("_or"), F.col("col").alias("_oc"))
    same = (F.col("_r") == F.col("_or")) & (F.col("_c") == F.col("_oc"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_o_{k}"))
    return wide.join(other, same, "left_anti").drop("_r", "_c")
