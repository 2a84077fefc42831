"""Connected components of links, as Spark jobs: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .repeats import join_groups


def _star(links: DataFrame, n: int, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node links to the node's least neighbour. Small: the node and its smaller neighbours do."""
    both = links.select("u", "v")
    if large:
        both = both.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("least"), F.count("*").alias("n"))
    joined = join_groups(both, least, "u", "n", 2 * n if large else n)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.select("u", F.col("least").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node of its component, for every node of the links (u, v). Each round is written; the loop ends when a round changes nothing, which is after some log² of the longest chain's rounds at most."""
    links = links.where(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    links = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = state(links)
    while before[0]:
        links = written(_star(written(_star(links, before[0], True)), before[0], False))
        now = state(links)
        if now == before:
            break
        before = now
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
