"""Mixing sources to target weights: Pareto order sampling.

Sources share all words by weight; a share stops at `most_copies` times the
source's own words and the excess goes to the others by weight. Within a source
every document has an expected number of copies, in proportion to the weight of
its length class (short texts carry less) and at most `most_copies`. Its whole
copies are certain. For the rest, a document has an inclusion probability p, and
documents are ranked by the random odds u / (1 - u) divided by p / (1 - p); the
first ones are taken until the source's target is met; of those after them, one
more is taken whose size brings the source nearest to its target. u is a hash of
the id, the text, the number of the row among equal ones and a seed, so reruns
agree.

The ranking never sorts a source in one place: ranks are cut into `cells` of
about equal expected size by the value of the Pareto key, words are summed by
source and cell, and only the documents of the one cell in which a source
reaches its target are ordered one by one.

Nulls and odd cases: a null text has size 0; a null source is a source of its
own and comes last; documents of size 0 are never taken. Rows that share an id,
or have none, are told apart by their text. Rows equal in source, id and text are
counted first and get numbers; each has a rank of its own. Equal ranks are ordered
by id, size, hash of the text and number. An empty table gives an empty result.
Other columns are not read by `mix`. The lists of sources and of their length
classes are held by single tasks: there may be thousands of sources, not one for
each document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stored import numbered
from .common import text_or_empty, written

#: Weights of sources in order of their names, repeating.
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def targets(sizes: DataFrame, most_copies: int = 3, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to most_copies times each source's size. One row per source, so its windows are as small as the list of sources."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.array(*map(F.lit, weights))
    sources = sources.withColumn("weight", F.get(n, (F.row_number().over(by_name) - 1) % len(weights)).cast("double"))
    everything = Window.partitionBy()
    sources = sources.withColumns({"limit": most_copies * F.col("source_size").cast("double"), "all": F.sum("source_size").over(everything).cast("double")})
    # Sources by limit over weight: the first ones stop at their limit, the others share what is left by weight. The level falls after the first one that does not stop, so the largest is theirs.
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = sources.withColumn("level", (F.col("all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    sources = sources.withColumn("stops", F.col("limit") <= F.col("level") * F.col("weight"))
    sources = sources.withColumn("share", F.max(F.when(~F.col("stops"), F.col("level"))).over(everything))
    target = F.when(F.col("stops") | F.col("share").isNull(), F.col("limit")).otherwise(F.col("share") * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def _rates(classes: DataFrame, most_copies: int) -> DataFrame:
    """(source, length_class, copies): expected copies of a document, min(most_copies, c × weight) with the c that meets the source's target.

    With classes by falling weight the heaviest ones reach most_copies first; c is found where the sum fits. At most a few dozen classes a source."""
    order = Window.partitionBy("source").orderBy(F.col("weight").desc(), "length_class")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    full = most_copies * F.coalesce(F.sum("words").over(before), F.lit(0))
    c = (F.col("target") - full) / F.sum(F.col("weight") * F.col("words")).over(rest)
    marked = classes.where("words > 0").withColumn("c", c).withColumn("full", F.col("c") * F.col("weight") >= most_copies)
    c = F.max(F.when(~F.col("full"), F.col("c"))).over(Window.partitionBy("source"))
    copies = F.when(F.col("full"), F.lit(float(most_copies))).otherwise(F.least(F.lit(float(most_copies)), c * F.col("weight")))
    return marked.select("source", "length_class", "target", "source_size", copies.alias("copies"))


#: Numbers of equal rows that one task gives at once.
SPREAD = 10_000
#: What tells rows apart.
ROW = ["id", "size", "key", "number"]


def alike(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, id, size, key, n): how many rows are equal in these; key is a hash of the text."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), word_count(text).cast("bigint").alias("size"), F.xxhash64(text).alias("key"))
    return rows.groupBy("source", "id", "size", "key").agg(F.count("*").alias("n"))


def each_row(groups: DataFrame) -> DataFrame:
    """A row for each of n equal ones, with its number; a large group is dealt out in parts of SPREAD."""
    groups = written(groups)
    few = groups.where(F.col("n") <= SPREAD).withColumn("number", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")))
    parts = groups.where(F.col("n") > SPREAD).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / SPREAD)))).repartition("id", "key", "part")
    many = parts.withColumn("number", F.explode(F.sequence(F.col("part") * SPREAD + 1, F.least("n", (F.col("part") + 1) * SPREAD)))).drop("part")
    return few.unionByName(many).drop("n")


def _mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_copies: int = 3, rows_per_cell: int = 4096, seed: int = 17) -> DataFrame:
    """One row per row of df: ROW, source, source_size, target, whole (certain copies) and extra (1 or 0)."""
    # Classes by powers of two; the weight of a class grows with length up to 256 words.
    length_class = F.least(F.floor(F.log2(F.greatest("size", F.lit(1)))), F.lit(30)).cast("int")
    u = (F.pmod(F.xxhash64(F.lit(seed), "id", "size", "key", "number"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sizes = written(each_row(alike(df, id_col, text_col, source_col)).withColumns({"length_class": length_class, "u": u}))
    cells = max(1024, -(-sizes.count() // rows_per_cell))

    classes = sizes.groupBy("source", "length_class").agg(F.sum("size").alias("words"))
    goal = targets(sizes, most_copies)
    weight = F.lit(0.5) + 0.5 * F.least(F.col("length_class"), F.lit(8)) / 8
    rates = written(_rates(classes.join(goal, classes["source"].eqNullSafe(goal["source"])).select(classes["source"], "length_class", "words", "target", "source_size", weight.alias("weight")), most_copies))
    goal = written(goal)

    # One row per source and class or per source: these lists are small, but their size is for Spark to judge.
    r = rates.select(F.col("source").alias("r_source"), F.col("length_class").alias("r_class"), "copies")
    g = goal.select(F.col("source").alias("g_source"), "source_size", "target")
    docs = sizes.join(r, sizes["source"].eqNullSafe(r["r_source"]) & (sizes["length_class"] == r["r_class"]), "left").drop("r_source", "r_class")
    docs = docs.join(g, docs["source"].eqNullSafe(g["g_source"])).drop("g_source")
    copies = F.when(F.col("size") > 0, F.coalesce("copies", F.lit(0.0))).otherwise(F.lit(0.0))
    whole = F.floor(copies + 1e-9)
    docs = docs.withColumns({"whole": whole.cast("bigint"), "p": F.greatest(copies - whole, F.lit(0.0))})
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    docs = docs.withColumn("rank", F.when((F.col("p") > 1e-9) & (F.col("p") < 1), odds))
    docs = written(docs.withColumn("cell", F.floor(F.col("rank") / (1 + F.col("rank")) * cells).cast("int")).drop("copies", "p", "u", "length_class"))

    # Words of certain copies, and words of the ranked ones by cell, give the cell where each source meets its target.
    sure = docs.groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.first("target").alias("target"))
    by_cell = docs.where("rank is not null").groupBy("source", "cell").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("cell"))
    by_cell = by_cell.join(sure.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", running + F.col("sure"))
    last = by_cell.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("target"), F.struct("cell", (F.col("upto") - F.col("words")).alias("start"), "target"))).alias("cut"))
    last = written(last.select(F.col("source").alias("c_source"), F.coalesce("cut.cell", F.lit(cells)).alias("cut"), "cut.start", F.col("cut.target").alias("need")))

    marked = docs.join(last, docs["source"].eqNullSafe(last["c_source"]), "left").drop("c_source")
    within = Window.partitionBy("source").orderBy("rank", *ROW).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = F.col("rank").isNotNull() & (F.col("cell") == F.col("cut"))
    edge = marked.where(at_cut).withColumn("before", F.col("start") + F.sum("size").over(within) - F.col("size"))
    # The first ones that fit are taken; those after them, in this cell or later ones, may fill the gap that is left.
    edge = edge.withColumn("extra", (F.col("before") + F.col("size") <= F.col("need")).cast("bigint")).drop("before")
    rest = marked.where(~F.coalesce(at_cut, F.lit(False))).withColumn("extra", F.coalesce((F.col("cell") < F.col("cut")).cast("bigint"), F.lit(0)))
    taken = written(rest.unionByName(edge))
    # Written, so that their size is known and short lists of sources need no shuffle of the documents.
    copies = F.col("whole") + F.col("extra")
    gaps = written(taken.groupBy("source").agg((F.first("target") - F.sum(copies * F.col("size"))).alias("gap")).withColumnRenamed("source", "g_source"))
    may = taken.where("rank is not null and extra = 0").join(gaps, taken["source"].eqNullSafe(F.col("g_source")))
    off = F.abs(F.col("gap") - F.col("size"))
    filler = may.where(off < F.abs("gap")).groupBy("g_source").agg(F.min(F.struct(off.alias("off"), "rank", *ROW)).alias("filler"))
    filler = written(filler.select("g_source", *(F.col(f"filler.{c}").alias(f"f_{c}") for c in ROW)))
    taken = taken.join(filler, taken["source"].eqNullSafe(F.col("g_source")), "left")
    same = F.col("g_source").eqNullSafe(F.col("source")) & F.col("f_key").isNotNull()
    for c in ROW:
        same = same & F.col(c).eqNullSafe(F.col(f"f_{c}"))
    return taken.select(*ROW, "source", "source_size", "target", "whole", (F.col("extra") + same.cast("bigint")).alias("extra"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most_copies: int = 3, rows_per_cell: int = 4096, seed: int = 17) -> DataFrame:
    """One row per row of df: id, size, source_size, target, copies (how often the mix takes it), taken (its words). There are so many cells that one holds about rows_per_cell rows."""
    copies = F.col("whole") + F.col("extra")
    return _mixed(df, id_col, text_col, source_col, most_copies, rows_per_cell, seed).select("id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of df as often as the mix takes them, with all their columns. Of rows equal in source, id and text any may have the additional copies."""
    by = ["source", "id", "size", "key"]
    groups = _mixed(df, id_col, text_col, source_col, **settings).groupBy(*by).agg(F.count("*").alias("n"), F.first("whole").alias("whole"), F.sum("extra").alias("extra"))
    groups = written(groups.where("whole + extra > 0").select(*(F.col(c).alias(f"g_{c}") for c in by), "n", "whole", "extra"))
    text = text_or_empty(text_col)
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), F.col(id_col).alias("id"), word_count(text).cast("bigint").alias("size"), F.xxhash64(text).alias("key"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    # Groups of several rows are written: where their list is short it is broadcast, and a large group's rows need not meet in one task.
    single = rows.join(groups.where("n = 1"), same).select("row", (F.col("whole") + F.col("extra")).alias("copies"))
    several = written(groups.where("n > 1"))
    taken = single
    if not several.isEmpty():
        again = numbered(rows.join(several, same), by, [], "at").select("row", (F.col("whole") + (F.col("at") < F.col("extra")).cast("bigint")).alias("copies")).where("copies > 0")
        taken = single.unionByName(again)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("row.*")
