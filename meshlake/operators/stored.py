"""Tables written between steps, and numbers within keys that need no key in one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_paths: list[str] = []


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables and folders that operators made in this process; results that were not taken yet can no longer be. Gives their number."""
    gone = 0
    while _paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(_paths.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshlake-")
        spark.sparkContext.setCheckpointDir(found)
    _paths.append(f"{found.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _paths[-1]


def stored(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors, and is the same each time it is read."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def around(df: DataFrame, keys: list[str], order: list[str], value: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """df with `before` and `after`: a value's last one that is not null up to a row of its key in an order, and the first one from it on.

    A key may span many tasks: rows are range-partitioned by key and order and written once; of each key's part only its
    first and last value go on to the others. Few enough rows for one task are not written. Ties are in any order."""
    n = df.count()
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    parts = tied.withColumn("_part", F.lit(0))
    if n > rows_per_task:
        parts = tied.repartitionByRange(-(-n // rows_per_task), *keys, *order, "_tie")
        parts = stored(parts.withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part", *keys).orderBy(*order, "_tie")
    own = {"before": F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "after": F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}
    found = parts.withColumns(own)
    if n > rows_per_task:
        at = F.when(F.col(value).isNotNull(), F.struct(*order, "_tie"))
        ends = parts.groupBy(*keys, "_part").agg(F.max_by(value, at).alias("_last"), F.min_by(value, at).alias("_first"))
        across = Window.partitionBy(*keys).orderBy("_part")
        past = F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))
        next_ = F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing))
        ends = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), past.alias("_past"), next_.alias("_next"))
        same = F.col("_part") == F.col("_p")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        found = found.join(ends, same).withColumns({"before": F.coalesce("before", "_past"), "after": F.coalesce("after", "_next")})
        found = found.drop("_p", "_past", "_next", *(f"_k{i}" for i in range(len(keys))))
    return found.drop("_tie", "_part")


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "row_id", rows_per_task: int = 1_000_000) -> DataFrame:
    """df with numbers from 0 within each key (over all rows without keys), in an order; a key may span many tasks.

    Rows are range-partitioned by key and order into tasks of about rows_per_task and written once, so that the counts
    and the numbered rows see the same parts. Rows that are equal in key and order are numbered in any order, which is
    written with them, so that a repeated task gives the same numbers; they too may span many tasks."""
    tasks = max(1, -(-df.count() // rows_per_task))
    parts = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys, *order, "_tie")
    parts = stored(parts.withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = parts.withColumn("_own", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order, "_tie")) - 1)
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return own.join(first, same).withColumn(out, F.col("_first") + F.col("_own")).drop("_tie", "_part", "_own", "_p", "_first", *(f"_k{i}" for i in range(len(keys))))
