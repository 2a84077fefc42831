"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a class for Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="meshlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame, codec: str = "lz4") -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> int:
    """Deletes the tables that `written` made in this process; results that were not taken yet can no longer be. Gives their number."""
    gone = 0
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def row_key(id_col: str, text: Column) -> Column:
    """64 bits that tell rows apart which share an id or have none; rows with equal id and text have equal ones."""
    return F.xxhash64(F.col(id_col).cast("bigint"), text)


def let(value: Column, f) -> Column:
    """f of value. Value is worked out once a row, also where Spark moves the expression into a filter or another projection."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with as many underscores after it as no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
