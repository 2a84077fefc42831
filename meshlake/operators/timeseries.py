"""Time series: grouping into steps, nearest-time joins, retiming, and sliding groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import basis
from .stored import around, numbered


def timestep_groups(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The k-th row of each key by time forms step k, whose time is its rows' mean: (step, step_time, n, ids in order of tie)."""
    return numbered(df, keys, [time, tie], "step").groupBy("step").agg(F.avg(time).alias("step_time"), F.count("*").alias("n"), F.min(tie).alias("first_id"), F.max(tie).alias("last_id"))


def nearest(times: DataFrame, steps: DataFrame, keys: list[str], time: str, step_time: str, tie: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """For each row of times the row of steps with the nearest time and the least tie of equal ones.

    An as-of join: both sides are sorted together once; the nearest step lies just before or just after. A key may span many tasks."""
    at = lambda df, c, own: df.select(*keys, F.col(c).cast("double").alias("_t"), F.lit(own).alias("_own"), (F.struct(*[x for x in df.columns if x not in keys])).alias("_row"))
    left = at(times, time, 1).withColumnRenamed("_row", "_left")
    groups = steps.groupBy(*keys, F.col(step_time).alias("_s")).agg(F.min(tie).alias("_tie"))
    right = groups.select(*keys, F.col("_s").cast("double").alias("_t"), F.lit(0).alias("_own"), F.struct(F.col("_s").cast("double").alias("t"), F.col("_tie").alias("tie")).alias("_step"))
    both = left.withColumn("_step", F.lit(None).cast(right.schema["_step"].dataType)).unionByName(right.withColumn("_left", F.lit(None).cast(left.schema["_left"].dataType)))
    found = around(both, keys, ["_t", "_own"], "_step", rows_per_task).withColumnsRenamed({"before": "_b", "after": "_a"}).where("_own = 1")
    gap = lambda c: F.abs(F.col(c)["t"] - F.col("_t"))
    take_after = F.col("_b").isNull() | (gap("_a") < gap("_b")) | ((gap("_a") == gap("_b")) & (F.col("_a")["tie"] < F.col("_b")["tie"]))
    best = F.when(F.col("_a").isNotNull() & take_after, F.col("_a")).otherwise(F.col("_b"))
    return found.withColumn("_best", best).select(*keys, "_left.*", F.col("_best.t").alias("nearest_time"), F.col("_best.tie").alias("nearest_id"))


def invert(df: DataFrame, keys: list[str], time: str, tie: str, payload: str) -> DataFrame:
    """Payloads in reverse order, times as they are."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = numbered(df, keys, [time, tie], "_k").join(sizes, keys)
    other = ranked.select(*keys, (F.col("_n") - 1 - F.col("_k")).alias("_k"), F.col(payload).alias("_p"))
    return ranked.join(other, [*keys, "_k"]).withColumn(payload, F.col("_p")).drop("_k", "_n", "_p")


def mean_gap(time: str) -> Column:
    """Mean of the differences between neighbours: (last - first) / (n - 1)."""
    n = F.count(time)
    return F.when(n > 1, (F.max(time) - F.min(time)) / F.when(n > 1, n - 1)).otherwise(0.0)


def interval(time: str) -> Column:
    """(last - first) / n, as time schemes store it."""
    return (F.max(time) - F.min(time)) / F.count(time)


def offset(df: DataFrame, keys: list[str], time: str, by: float | None = None) -> DataFrame:
    """Times moved by a value, or by half their mean gap."""
    if by is not None:
        return df.withColumn(time, F.col(time) + by)
    gaps = df.groupBy(*keys).agg((mean_gap(time) / 2).alias("_half"))
    return df.join(gaps, keys).withColumn(time, F.col(time) + F.col("_half")).drop("_half")


def reorder_cycle(df: DataFrame, keys: list[str], time: str, tie: str, start: float, step: float) -> DataFrame:
    """Steps turned so that the one nearest to start is first; times become i × step."""
    ranked = numbered(df, keys, [time, tie], "_k")
    first = ranked.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(F.abs(F.col(time) - start).alias("d"), F.col("_k").alias("k")))["k"].alias("_first"))
    at = F.pmod(F.col("_k") - F.col("_first"), F.col("_n"))
    return ranked.join(first, keys).withColumn("new_time", at * F.lit(float(step))).drop("_k", "_n", "_first")


def sequence_times(df: DataFrame, order: list[str], per_step: int, times: float, keys: list[str]) -> DataFrame:
    return numbered(df, keys, order, "_k").withColumn("seq_time", F.floor(F.col("_k") / per_step) * F.lit(float(times))).drop("_k")


def successive(df: DataFrame, keys: list[str], order: list[str], value: str, cyclic: bool = False) -> DataFrame:
    """Each value with the next one; the last with the first if cyclic, else without a row. Rows meet by their numbers, so a key may span many tasks; keys are not null."""
    ranked = numbered(df, keys, order, "_k")
    place = F.col("_k") - 1
    if cyclic:
        sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_n"))
        place = F.pmod(F.col("_k") - 1, F.col("_n"))
    after = (ranked.join(sizes, keys) if cyclic else ranked).select(*keys, place.alias("_k"), F.col(value).alias("next_value"))
    return ranked.join(after, [*keys, "_k"]).drop("_k")


def chunks(df: DataFrame, keys: list[str], order: list[str], value: str, width: int) -> DataFrame:
    """Values in groups of `width`; a short last group is dropped."""
    ranked = numbered(df, keys, order, "_k").withColumn("chunk", F.floor(F.col("_k") / width))
    out = ranked.groupBy(*keys, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", value))), lambda c: c[value]).alias("vals"))
    return out.where(F.size("vals") == width)


def displacement(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """df with how far a value is from that of its key's first row."""
    first = df.groupBy(key).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    return df.join(first, key).withColumn("displacement", F.abs(F.col(value) - F.col("_first"))).drop("_first")


def extract_steps(df: DataFrame, keys: list[str], time: str, tie: str, wanted: list[float], renumber: bool = False) -> DataFrame:
    """(wanted, keys, row): for each wanted time the row of each key with the nearest time; the list of times is short and goes to every row.

    With renumber, `step_time` counts the wanted times from 0."""
    times = F.array(*(F.struct(F.lit(k).alias("step"), F.lit(float(t)).alias("wanted")) for k, t in enumerate(sorted(wanted))))
    rows = df.select(*keys, F.struct(F.col(time).alias("t"), F.col(tie).alias("tie")).alias("_r"), F.explode(times).alias("_w"))
    gap = F.struct(F.abs(F.col("_r.t") - F.col("_w.wanted")).alias("gap"), F.col("_r.tie").alias("tie"), F.col("_r.t").alias("t"))
    best = rows.groupBy(*keys, F.col("_w.step").alias("step"), F.col("_w.wanted").alias("wanted")).agg(F.min(gap).alias("_best"))
    at = F.col("step").cast("double") if renumber else F.col("wanted")
    return best.select(*keys, at.alias("step_time"), F.col("_best.t").alias("nearest_time"), F.col("_best.tie").alias("nearest_id"))


def retime(df: DataFrame, keys: list[str], time: str, tie: str, start: float, step: float) -> DataFrame:
    """Times start, start + step, ... in the order of the old ones."""
    return numbered(df, keys, [time, tie], "_k").withColumn("new_time", start + F.col("_k") * float(step)).drop("_k")


def add_step(df: DataFrame, keys: list[str], time: str, at: float, value: str, new: float) -> DataFrame:
    """df with one more row (keys, time, value) a key."""
    more = df.select(*keys).distinct().withColumns({time: F.lit(float(at)), value: F.lit(float(new))})
    return df.select(*keys, time, value).unionByName(more)


def fill_from_first(df: DataFrame, keys: list[str], time: str, tie: str, value: str) -> DataFrame:
    """All values of a key as that of its first time."""
    first = df.groupBy(*keys).agg(F.min_by(value, F.struct(time, tie)).alias("_first"))
    return df.join(first, keys).withColumn(value, F.col("_first")).drop("_first")


def update_nearest(df: DataFrame, keys: list[str], time: str, tie: str, at: float, value: str, new: float) -> DataFrame:
    """The value of each key's row nearest to a time replaced."""
    near = df.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(time) - at).alias("gap"), F.col(tie).alias("tie")))["tie"].alias("_near"))
    return df.join(near, keys).withColumn(value, F.when(F.col(tie) == F.col("_near"), F.lit(float(new))).otherwise(F.col(value))).drop("_near")


def oriented_groups(df: DataFrame, keys: list[str], orientation: list[str], time: str, tie: str, digits: int = 3) -> DataFrame:
    """(keys, rounded orientation, ids in time order, n): images grouped by orientation, equal to so many digits."""
    rounded = [F.round(c, digits).alias(c) for c in orientation]
    return df.groupBy(*keys, *rounded).agg(F.transform(F.array_sort(F.collect_list(F.struct(time, tie))), lambda x: x[tie]).alias("ids"), F.count("*").alias("n"))


def first_or(df: DataFrame, keys: list[str], order: list[str], value: str, default: float) -> DataFrame:
    """(keys, first_value, last_value), the default where a key has no value."""
    rows = F.struct(*order, F.col(value).alias("_v"))
    ends = df.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), rows))["_v"].alias("_a"), F.max(F.when(F.col(value).isNotNull(), rows))["_v"].alias("_b"))
    return ends.select(*keys, F.coalesce("_a", F.lit(default)).alias("first_value"), F.coalesce("_b", F.lit(default)).alias("last_value"))


def control_curve(v: Column, xs: list[float], ys: list[float], linear: bool = False) -> Column:
    """A curve through control points at v, cubic (Catmull-Rom, end points doubled) or linear, clamped at both ends."""
    out = F.when(v <= xs[0], float(ys[0]))
    for k in range(len(xs) - 1):
        t = (v - xs[k]) / (xs[k + 1] - xs[k])
        if linear:
            y = ys[k] + (ys[k + 1] - ys[k]) * t
        else:
            own = [ys[max(0, k - 1)], ys[k], ys[k + 1], ys[min(len(ys) - 1, k + 2)]]
            y = basis.combine(basis.catmull_rom(t), [F.lit(float(p)) for p in own])
        out = out.when(v <= xs[k + 1], y)
    return out.otherwise(float(ys[-1]))
