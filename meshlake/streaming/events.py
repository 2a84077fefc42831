"""An extension: time windows over a stream of (ts, key, value) with late data, as the batch aggregations have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def windowed(df: DataFrame, time: str, keys: list[str], value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, keys, n, total, least, most) of tumbling windows; rows later than `late` are left out, and their state is dropped."""
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, width)
    out = df.withWatermark(time, late).groupBy(w, *keys) if df.isStreaming else df.groupBy(w, *keys)
    return out.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), *keys, "n", "total", "least", "most")
