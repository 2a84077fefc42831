"""Masks of moving regions: erosion, filters and convex hulls of the pixels of images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored
from .volumes import largest_object


def erode_cross(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, row, col) of a mask whose four neighbours lie in it, too."""
    steps = F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))))
    sent = mask.select(*keys, "row", "col", F.explode(steps).alias("_s"))
    near = sent.groupBy(*keys, (F.col("row") + F.col("_s.r")).alias("row"), (F.col("col") + F.col("_s.c")).alias("col")).agg(F.count("*").alias("_n"))
    return near.where("_n = 5").select(*keys, "row", "col")


def widen(mask: DataFrame, keys: list[str], size: int, rows: int, cols: int) -> DataFrame:
    """Pixels with one of the mask in the window of `size` around them; an even window reaches one further back than on. One axis after another."""
    out = mask.select(*keys, "row", "col")
    for axis, n in (("row", rows), ("col", cols)):
        other = "col" if axis == "row" else "row"
        at = F.explode(F.sequence(F.col(axis) - (size - size // 2 - 1), F.col(axis) + size // 2))
        out = out.select(*keys, other, at.alias(axis)).where(F.col(axis).between(0, n - 1)).distinct()
    return out.select(*keys, "row", "col")


def _hull_rows(points: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first col, last col) of the whole places within the convex hull of points (row, col)."""

    def chain(side: int) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for p in points[np.lexsort((points[:, 1] * side, points[:, 0]))]:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) * side <= (p[0] - out[-2][0]) * (out[-1][1] - out[-2][1]) * side:
                out.pop()
            out.append(p)
        return out

    rows = np.arange(points[:, 0].min(), points[:, 0].max() + 1)
    ends = []
    for side in (1, -1):
        corners = np.array(chain(side))
        # Of several corners in a row the outermost counts.
        names, first = np.unique(corners[:, 0], return_index=True)
        outer = np.array([(corners[corners[:, 0] == r][:, 1] * side).min() * side for r in names])
        ends.append(np.interp(rows, names, outer))
    return [(int(r), int(np.ceil(a - 1e-9)), int(np.floor(b + 1e-9))) for r, a, b in zip(rows, *ends)]


def convex_hull(mask: DataFrame, keys: list[str]) -> DataFrame:
    """The pixels within the convex hull of each image's mask. Only the first and last pixel of each row reach the one task that finds an image's hull."""
    ends = mask.groupBy(*keys, "row").agg(F.min("col").alias("_a"), F.max("col").alias("_b"))
    kinds = dict(mask.dtypes)

    def hull(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(np.concatenate([pdf[["row", "_a"]].to_numpy(), pdf[["row", "_b"]].to_numpy()]), axis=0)
        found = pd.DataFrame(_hull_rows(points), columns=["row", "_a", "_b"])
        return found.assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "row", "_a", "_b"]]

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "row int, _a int, _b int"])
    rows = ends.groupBy(*keys).applyInPandas(hull, schema)
    return rows.select(*keys, "row", F.explode(F.sequence("_a", "_b")).alias("col"))


def motion_mask(motion: DataFrame, keys: list[str], rows: int, cols: int, share: float = 0.9, size: int = 10) -> DataFrame:
    """(keys, row, col) where images move: what is over their percentile, eroded by a pixel, its largest object, widened by a window and made convex. motion: (keys, row, col, motion), one for each pixel."""
    limits = motion.groupBy(*keys).agg(F.percentile("motion", share).alias("_p"))
    over = motion.join(limits, keys).where(F.col("motion") > F.col("_p")).select(*keys, "row", "col")
    one = largest_object(stored(erode_cross(over, keys)), keys)
    return convex_hull(stored(widen(one, keys, size, rows, cols)), keys)
