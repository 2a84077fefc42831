"""Ordered outlines of masks: the sides of pixels as closed loops, by list ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import stored
from .volumes import mask_edges

#: Sides of a pixel in the order of a walk around it: where the neighbour beyond lies, and the corner where the side starts.
SIDES = ((-1, 0, 0, 0), (0, 1, 0, 1), (1, 0, 1, 1), (0, -1, 1, 0))


def sides(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, side): the sides of a mask's pixels beyond which there is none of it; sides count from the top to the right."""
    side = F.lit(None)
    for k, (dr, dc, _, _) in enumerate(SIDES):
        side = F.when((F.col("dr") == dr) & (F.col("dc") == dc), k) if k == 0 else side.when((F.col("dr") == dr) & (F.col("dc") == dc), k)
    return mask_edges(mask, keys).select(*keys, F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), side.cast("bigint").alias("side"))


def successors(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, side, next): after a side comes the pixel's next side, else the same side of the pixel ahead, else
    the side before of the pixel ahead and outward. So a walk stays with pixels that share sides, not corners."""
    options = []
    for k, (dr, dc, _, _) in enumerate(SIDES):
        ahead = SIDES[(k + 1) % 4]
        steps = ((0, 0, (k + 1) % 4), (ahead[0], ahead[1], k), (ahead[0] + dr, ahead[1] + dc, (k + 3) % 4))
        options.append(F.array(*(F.struct(F.lit(rank).alias("rank"), (F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(s).cast("bigint").alias("side")) for rank, (r, c, s) in enumerate(steps))))
    wide = edges.withColumn("_o", F.explode(F.get(F.array(*options), F.col("side").cast("int"))))
    wide = wide.select(*keys, F.struct("row", "col", "side").alias("_from"), F.col("_o.rank").alias("_rank"), "_o.row", "_o.col", "_o.side")
    found = wide.join(edges, [*keys, "row", "col", "side"])
    return found.groupBy(*keys, "_from").agg(F.min(F.struct("_rank", "row", "col", "side")).alias("_n")).select(*keys, "_from.*", F.struct("_n.row", "_n.col", "_n.side").alias("next"))


def ranked_loops(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, col, side, loop, at, n): each side's loop, named by its least side, its place from there, and the loop's length.

    Every round doubles the stretch of the loop of which a side knows the least one and the way to it; the rounds end
    when no side learns anything, which is when the stretch is as long as the longest loop. A round is one join by side."""
    own = F.struct("row", "col", "side")
    state = stored(successors(edges, keys).select(*keys, own.alias("id"), "next", own.alias("least"), F.lit(0).cast("bigint").alias("way")))
    span = 1
    while True:
        ahead = state.select(*keys, F.col("id").alias("next"), F.col("next").alias("_next"), F.col("least").alias("_least"), (F.col("way") + span).alias("_way"))
        better = F.col("_least") < F.col("least")
        new = state.join(ahead, [*keys, "next"]).select(*keys, "id", F.col("_next").alias("next"), F.when(better, F.col("_least")).otherwise(F.col("least")).alias("least"), F.when(better, F.col("_way")).otherwise(F.col("way")).alias("way"), better.alias("_moved"))
        new = stored(new)
        state, span = new.drop("_moved"), span * 2
        if new.where("_moved").isEmpty():
            break
    lengths = state.groupBy(*keys, "least").agg(F.count("*").alias("n"))
    found = state.join(lengths, [*keys, "least"])
    return found.select(*keys, "id.*", F.col("least").alias("loop"), ((F.col("n") - F.col("way")) % F.col("n")).alias("at"), "n")


def outlines(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loop, at, x, y, n, area): the corners of every outline in order, with the area that it encloses.

    Outlines run clockwise as seen (y downward) around objects, with positive area, and the other way around holes, with
    negative area; the areas of a mask's outlines add up to its pixels. Objects are pixels that share sides."""
    ranked = ranked_loops(sides(mask, keys), keys)
    corner = lambda k: F.get(F.lit([s[k] for s in SIDES]), F.col("side").cast("int"))
    placed = stored(ranked.select(*keys, "loop", "at", (F.col("col") + corner(3)).cast("double").alias("x"), (F.col("row") + corner(2)).cast("double").alias("y"), "n", "side"))
    # A side to the right adds minus its height, one to the left adds it: the sum of these is the area, downward y being positive.
    areas = placed.groupBy(*keys, "loop").agg(F.sum(F.when(F.col("side") == 0, -F.col("y")).when(F.col("side") == 2, F.col("y")).otherwise(0.0)).alias("area"))
    return placed.drop("side").join(areas, [*keys, "loop"])


def turning_points(outline: DataFrame) -> DataFrame:
    """The corners of outlines at which they turn, as (…, p): what a polygon needs."""
    from pyspark.sql import Window

    keys = [c for c in outline.columns if c not in ("at", "x", "y", "n", "area")]
    w = Window.partitionBy(*keys).orderBy("at")
    ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    turns = lambda c: (F.coalesce(F.lead(c).over(w), F.first(c).over(ends)) - F.col(c)) != (F.col(c) - F.coalesce(F.lag(c).over(w), F.last(c).over(ends)))
    marked = outline.withColumn("_turns", turns("x") | turns("y"))
    return marked.where("_turns").select(*keys, "at", F.struct("x", "y", F.lit(0.0).alias("z")).alias("p"), "area")
