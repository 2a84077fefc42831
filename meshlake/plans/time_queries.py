"""Time steps, nearest-time joins, retiming and sliding groups, over events by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import agg, timeseries
from .registry import query, table

SECONDS = "(epoch_us(ts) / 1000000.0)"


def events(spark, d):
    """(event_id, user_id, event_type, value, t): seconds as a double."""
    return table(spark, d, "events").select("event_id", "user_id", "event_type", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))


@query("timestep_group", f"""WITH k AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) - 1 AS step, {SECONDS} AS t, event_id FROM events)
SELECT step, round(avg(t), 3) AS step_time, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM k GROUP BY 1""")
def _(spark, d):
    return timeseries.timestep_groups(events(spark, d), ["user_id"], "t", "event_id").withColumn("step_time", F.round("step_time", 3))


@query("nearest_ts_join", f"""WITH e AS (SELECT user_id, event_id, {SECONDS} AS t, event_type FROM events), a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT user_id, t, min(event_id) AS event_id FROM e WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT a.event_id, round(b.t, 6) AS nearest_time, b.event_id AS nearest_id FROM a JOIN b USING (user_id) QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.event_id) = 1""")
def _(spark, d):
    e = events(spark, d)
    clicks, rest = e.where("event_type = 'click'").select("user_id", "event_id", "t"), e.where("event_type <> 'click'")
    found = timeseries.nearest(clicks, rest, ["user_id"], "t", "t", "event_id").where("nearest_id is not null")
    return found.select("event_id", F.round("nearest_time", 6).alias("nearest_time"), "nearest_id")


@query("invert_ts", f"""WITH k AS (SELECT *, {SECONDS} AS t, row_number() OVER w AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {SECONDS}, event_id))
SELECT a.event_id, round(b.value, 6) AS value FROM k a JOIN k b ON a.user_id = b.user_id AND b.k = a.n + 1 - a.k""")
def _(spark, d):
    return timeseries.invert(events(spark, d), ["user_id"], "t", "event_id", "value").select("event_id", F.round("value", 6).alias("value"))


@query("offset_ts", f"""WITH e AS (SELECT event_id, user_id, {SECONDS} AS t FROM events), g AS (SELECT user_id, CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0 END / 2 AS h FROM e GROUP BY 1)
SELECT event_id, round(t + h, 3) AS t FROM e JOIN g USING (user_id)""")
def _(spark, d):
    return timeseries.offset(events(spark, d), ["user_id"], "t").select("event_id", F.round("t", 3).alias("t"))


@query("reorder_cycle", """WITH k AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, arg_min(k, (abs(value - 10), k)) AS f FROM k GROUP BY 1) SELECT event_id, (((k - f + n) % n) * 0.5)::DOUBLE AS new_time FROM k JOIN f USING (user_id)""")
def _(spark, d):
    return timeseries.reorder_cycle(events(spark, d), ["user_id"], "value", "event_id", 10.0, 0.5).select("event_id", "new_time")


@query("avg_span", f"""WITH e AS (SELECT user_id, {SECONDS} AS t FROM events) SELECT user_id, round(CASE WHEN count(*) > 1 THEN (max(t) - min(t)) / (count(*) - 1) ELSE 0 END, 3) AS mean_gap, round((max(t) - min(t)) / count(*), 3) AS span FROM e GROUP BY 1""")
def _(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.round(timeseries.mean_gap("t"), 3).alias("mean_gap"), F.round(timeseries.interval("t"), 3).alias("span"))


@query("create_sequence", f"SELECT event_id, (floor((row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) - 1) / 4) * 40)::DOUBLE AS seq_time FROM events")
def _(spark, d):
    return timeseries.sequence_times(events(spark, d), ["t", "event_id"], 4, 40.0, ["user_id"]).select("event_id", F.col("seq_time").cast("double").alias("seq_time"))


@query("measure_displacement", f"SELECT event_id, round(abs(value - first_value(value) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id)), 6) AS displacement FROM events")
def _(spark, d):
    return timeseries.displacement(events(spark, d), "user_id", ["t", "event_id"], "value").select("event_id", F.round("displacement", 6).alias("displacement"))


@query("circumference", f"""WITH s AS (SELECT user_id, value, {SECONDS} AS t, lead(value) OVER w AS nv, first_value(value) OVER w AS fv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY {SECONDS}, event_id))
SELECT user_id, round(sum(abs(coalesce(nv, fv) - value)), 4) AS length FROM s GROUP BY 1""")
def _(spark, d):
    pairs = timeseries.successive(events(spark, d), ["user_id"], ["t", "event_id"], "value", cyclic=True)
    return pairs.groupBy("user_id").agg(F.round(F.sum(F.abs(F.col("next_value") - F.col("value"))), 4).alias("length"))


@query("successive_pairs", f"SELECT * FROM (SELECT event_id, round(lead(value) OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id), 6) AS next_value FROM events) WHERE next_value IS NOT NULL")
def _(spark, d):
    return timeseries.successive(events(spark, d), ["user_id"], ["t", "event_id"], "value").select("event_id", F.round("next_value", 6).alias("next_value"))


@query("group_chunks", f"""WITH k AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {SECONDS}, event_id) - 1 AS k FROM events)
SELECT user_id, k // 3 AS chunk, list(event_id ORDER BY k) AS vals FROM k GROUP BY 1, 2 HAVING count(*) = 3""")
def _(spark, d):
    return timeseries.chunks(events(spark, d), ["user_id"], ["t", "event_id"], "event_id", 3)


@query("spectrum_lookup", "SELECT event_id, round(CASE WHEN value <= 0 THEN 0 WHEN value <= 50 THEN value / 50 * 0.8 WHEN value <= 100 THEN 0.8 + (value - 50) / 50 * 0.2 ELSE 1 END, 6) AS level FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(scalars.spectrum(F.col("value"), [(0, 0.0), (50, 0.8), (100, 1.0)]), 6).alias("level"))


@query("lerp_clamp_wrap", """SELECT event_id, round((value - 10) / 80, 6) AS xi, greatest(0::DOUBLE, least(1::DOUBLE, round((value - 10) / 80, 6))) AS clamped,
round(CASE WHEN value BETWEEN -pi() AND pi() THEN value ELSE (value + pi()) - floor((value + pi()) / (2 * pi())) * 2 * pi() - pi() END, 6) AS angle FROM events""")
def _(spark, d):
    v = F.col("value")
    xi = F.round(scalars.lerp_xi(v, 10, 90), 6)
    return table(spark, d, "events").select("event_id", xi.alias("xi"), scalars.clamp(xi, 0, 1).alias("clamped"), F.round(scalars.wrap_angle(v), 6).alias("angle"))


@query("report_upsert", f"SELECT user_id, event_type, arg_max(round(value, 6), ({SECONDS}, event_id)) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    e = events(spark, d).withColumn("value", F.round("value", 6))
    return agg.upsert_latest(e, ["user_id", "event_type"], ["t", "event_id"], "value")


@query("event_statistics", "SELECT user_id, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev, round(sqrt(sum(value * value)), 4) AS norm, arg_min(event_id, (value, event_id)) AS argmin, arg_min(event_id, (-value, event_id)) AS argmax FROM events GROUP BY 1")
def _(spark, d):
    s = agg.statistics(events(spark, d), ["user_id"], "value", "event_id")
    return s.select("user_id", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), F.round("norm", 4).alias("norm"), "argmin", "argmax")


@query("series_pivot", "SELECT user_id, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click, round(coalesce(sum(value) FILTER (event_type = 'view'), 0), 4) AS view FROM events GROUP BY 1")
def _(spark, d):
    wide = agg.pivot_series(events(spark, d), "user_id", "event_type", ["click", "view"], "value")
    return wide.select("user_id", *(F.round(c, 4).alias(c) for c in ("click", "view")))
