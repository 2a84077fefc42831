"""Strings, names, paths and parsed header values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import numbered


def sort_token(name: Column, at: int) -> Column:
    """The at-th part of a name split at | _ - . and spaces, as a number; null if it is none."""
    return F.get(F.split(name, r"[|_. -]"), at).try_cast("bigint")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k))
    return F.array_max(same)


def common_fraction(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, common_prefix(a, b) / F.when(n > 0, n)).otherwise(0.0)


def matches(name: Column, pattern: str) -> Column:
    """Equal, or with the pattern's start if it ends in *."""
    return name.startswith(pattern[:-1]) if pattern.endswith("*") else name == pattern


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Names made different: name, name_01, name_02, in order; numbers that make a name of the table are left out."""
    parts = df.select(F.regexp_extract(name, r"^(.*)_\d{2,}$", 1).alias("_base"), F.regexp_extract(name, r"_(\d{2,})$", 1).try_cast("bigint").alias("_n"))
    taken = parts.where("_n is not null").groupBy("_base").agg(F.sort_array(F.collect_set("_n")).alias("_taken"))
    ranked = numbered(df, [name], [order], "_k").join(taken, F.col(name) == F.col("_base"), "left")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_k").cast("bigint"), lambda k, n: F.when(n <= k, k + 1).otherwise(k))
    return ranked.withColumn(out, F.when(F.col("_k") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.format_string("_%02d", free)))).drop("_k", "_base", "_taken")


def valid_name(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_]", "_")


def data_size(n: Column) -> Column:
    """Bytes with two decimals and a unit; divided by 1024 while over 1000."""
    v, out = n.cast("double"), None
    units = ("B", "kB", "MB", "GB", "TB", "PB")
    for k, unit in enumerate(units):
        scaled = v / float(1024**k)
        text = F.concat(F.format_string("%.2f", F.bround(scaled, 2)), F.lit(unit))
        last = k == len(units) - 1
        out = F.when(scaled <= 1000, text) if out is None else out.otherwise(text) if last else out.when(scaled <= 1000, text)
    return out


def path_parts(path: Column) -> Column:
    """Struct (dir, base, ext); the extension begins at the last dot of the name."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    return F.struct(F.regexp_extract(path, r"^(.*)/[^/]*$", 1).alias("dir"), F.substring(name, F.lit(1), F.length(name) - F.length(ext)).alias("base"), ext.alias("ext"))


def heart_rate(text: Column) -> Column:
    """Beats a minute from 'RR <ms>' or '<n> bpm'; null without either."""
    interval = F.regexp_extract(text, r"RR\s*(\d+)", 1).try_cast("double")
    beats = F.regexp_extract(text, r"(\d+)\s*bpm", 1).try_cast("double")
    return F.coalesce(60000.0 / F.when(interval > 0, interval), beats)


def selection(spec: str, n: int) -> list[int]:
    """Indexes that '1,6-8,9-2-14,16-*' names: single ones, ranges and ranges with a step, without the upper end."""
    chosen: set[int] = set()
    for part in spec.replace(" ", "").split(","):
        bits = [n if b == "*" else int(b) for b in part.split("-")]
        found = [bits[0]] if len(bits) == 1 else range(bits[0], bits[-1], bits[1] if len(bits) == 3 else 1)
        chosen.update(found)
    if any(not 0 <= k < n for k in chosen):
        raise ValueError(f"{spec!r} names an index outside 0 to {n - 1}")
    return sorted(chosen)


def looked_up(df: DataFrame, name: str, part: str, condition: Column | None = None) -> DataFrame:
    """Rows whose name holds a part and that fulfil a condition."""
    found = df.where(F.contains(F.col(name), F.lit(part)))
    return found if condition is None else found.where(condition)


def tag_values(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, vals): a tag's values in order; equal ones once."""
    rows = df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("vals"))
    once = F.array_distinct("vals")
    return rows.select(key, F.when(F.size(once) == 1, once).otherwise(F.col("vals")).alias("vals"))


def find_name(df: DataFrame, name: str, pattern: str, order: str) -> DataFrame:
    """The first row in an order whose name a pattern matches: the one row is the feature."""
    return df.where(matches(F.col(name), pattern)).orderBy(order).limit(1)
