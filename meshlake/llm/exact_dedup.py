"""Exact deduplication by two-pass Bloom filtering.

Pass 1 reads a digest of each normalised text and counts, in a filter with
counters that stop at two, the cells that each digest sets. Cells that were
set twice form the filter of repeated digests. Pass 2 looks every digest up in
it: a digest with a cell that was set once is unique and passes straight
through; only the others shuffle and are grouped by their whole digest.

The filter has `bits_per_row` cells a row and at most `max_bits` cells, so what
is broadcast has a fixed bound (32 MB by default). With fewer cells a row more
unique rows shuffle; the result stays the same.

Nulls and odd cases: a null text counts as empty, and all empty texts are
copies of each other. A null id ranks behind all others. Of rows that share
text and id, one stays. An empty table gives an empty result. Other columns
are never read by `duplicate_groups` and are kept by `drop_duplicates`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, text_or_empty, written
from .repeats import join_groups, marked_repeats

def text_digest(text: str):
    """SHA-256 of the text with each run of ASCII white space as one space."""
    return F.unhex(F.sha2(F.regexp_replace(text_or_empty(text), f"{SPACE}+", " "), 256))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, digest (binary)."""
    digests = written(df.select(F.col(id_col).alias("id"), text_digest(text_col).alias("digest")))
    rows = digests.count()
    probed = marked_repeats(digests, F.xxhash64("digest"), rows, bits_per_row, max_bits)
    once = probed.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    found = written(probed.where("maybe").groupBy("digest", "id").agg(F.count("*").alias("n")))
    groups = found.groupBy("digest").agg(F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    several = join_groups(found, groups, "digest", "group_size", rows).select("id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "digest")
    return once.unionByName(several.select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "digest"))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_row: int = 16, max_bits: int = 1 << 28) -> DataFrame:
    """The rows of df that stay, with all their columns. Rows with a unique text pass straight through; only the others are joined with their groups."""
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), text_digest(text_col).alias("digest"))
    marked = marked_repeats(rows, F.xxhash64("digest"), df.count(), bits_per_row, max_bits)
    several = marked.where("maybe")
    keep = several.groupBy("digest").agg(F.min("id").alias("keep_id"))
    # One row of each text and id before they are joined, so that no task gets all repeats of a row.
    one = several.groupBy("digest", "id").agg(F.first("row").alias("row"))
    stay = one.join(keep.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    return marked.where("not maybe").select("row").unionByName(stay.select("row")).select("row.*")
