r"""WARC files of pages, and a Merkle fixity audit of their replicas.

`records` turns pages into WARC records and lays them out in files: a file is
chosen by a hash of the record and its number among equal ones, so no id makes a
file large; records follow each other by their SHA-256, and each has an offset.
`write_files` writes them with Spark's text sink (a record ends with two line
ends, which is the sink's separator), `read_records` parses files back by their
Content-Length: any records of any WARC files, with one gzip member a file or a
record. There is no warcinfo record, and Spark's sink writes one member a file.

A tree has the records' SHA-256 at its leaves. Nodes of the lowest level cover
ordered ranges of offsets of a file; upper ones cover `fanout` neighbours each,
up to one node a file and, over files, up to the root. `audit` compares the
roots of two replicas, then the children of those nodes that differ, level by
level, and at last the records in the ranges that differ.

Nulls and odd cases: a null page is an empty payload, a null URL leaves out the
target's header, a null id gives the record id `urn:page:none`. Repeated rows are
records of their own; a record is known by its file, its record id and its number
among the file's records with this id, by hash and offset. Bytes that do not
parse up to the next record are one record with a null id. An empty table has no
files and its audit no rows. Other columns are not read. A record that is the
same but elsewhere is `moved`.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

END = "\r\n"
RANGE_BYTES = 1 << 18
FANOUT = 16


def record_text(page_id: Column, url: Column, html: Column, date: str) -> Column:
    payload = F.coalesce(html.cast("string"), F.lit(""))
    record_id = F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))
    digest = F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(payload, 256))
    lines = [F.lit("WARC/1.1"), F.lit("WARC-Type: resource"), record_id, F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), url), digest, F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.octet_length(payload).cast("string"))]
    return F.concat(F.concat_ws(END, *lines), F.lit(END + END), payload)


RECORD_ID = r"\r\nWARC-Record-ID: <([^>\r\n]*)>"
#: Hashes of repeated records up to which they are broadcast (some 20 MB); more are joined by Spark's choice.
FEW = 200_000


@dataclass(frozen=True)
class Layout:
    """Records and their places in files: entries (record_id, sha256, number, length, file), records (record, sha256, number, file), and the number of files."""

    entries: DataFrame
    records: DataFrame
    files: int


def records(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z", file_bytes: int = 16 << 20) -> Layout:
    """The layout of a record for every page; number counts equal records, length has the two line ends after the record."""
    text = record_text(F.col(id_col).cast("bigint"), F.col(url_col), F.col(html_col), date)
    out = df.select(text.alias("record")).withColumn("sha256", F.sha2("record", 256))
    digests = written(out.select("sha256", F.regexp_extract("record", RECORD_ID, 1).alias("record_id"), (F.octet_length("record") + 4).cast("bigint").alias("length")))
    files = max(1, -(-(digests.agg(F.sum(F.col("length") - 4)).first()[0] or 0) // file_bytes))
    file = F.conv(F.substring(F.sha2(F.concat_ws(":", "sha256", "number"), 256), 1, 8), 16, 10).cast("bigint") % files
    numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("number")
    counts = written(digests.groupBy("sha256", "record_id", "length").agg(F.count("*").alias("n")))
    entries = counts.select("sha256", "record_id", "length", numbers).withColumn("file", file)
    # Equal records are counted by hash and made again from one of them, so that they need not meet in a task.
    several = counts.where("n > 1").select("sha256")
    many = several.count()
    found = out.select("record", "sha256", F.lit(1).cast("bigint").alias("number"))
    if many:
        hint = F.broadcast(several) if many <= FEW else several
        again = out.join(hint, "sha256", "left_semi").groupBy("sha256").agg(F.first("record").alias("record"), F.count("*").alias("n"))
        found = found.join(hint, "sha256", "left_anti").select("record", "sha256", "number").unionByName(again.select("record", "sha256", numbers))
    return Layout(entries, found.withColumn("file", file), files)


def _numbered(found: DataFrame) -> DataFrame:
    """(file, offset, record_id, copy, length, sha256); a window holds one file's records, whose number is bounded by the size of a file."""
    copy = F.row_number().over(Window.partitionBy("file", "record_id").orderBy("sha256", "offset"))
    return found.select("file", "offset", "record_id", copy.cast("bigint").alias("copy"), "length", "sha256")


def manifest(layout: Layout) -> DataFrame:
    """(file, offset, record_id, copy, length, sha256) of records in order, as they are to be written."""
    before = Window.partitionBy("file").orderBy("sha256", "number").rowsBetween(Window.unboundedPreceding, -1)
    return _numbered(layout.entries.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))))


def write_files(layout: Layout, path: str) -> None:
    """One gzip file per `file`, as file=N/part-*.txt.gz under path, each by a task of its own."""
    rows = layout.records.repartitionById(layout.files, F.col("file").cast("int")).sortWithinPartitions("file", "sha256", "number")
    _write(rows, path)


def _write(rows: DataFrame, path: str) -> None:
    rows.select("file", "record").write.partitionBy("file").option("lineSep", END + END).option("compression", "gzip").text(path)


def _parsed(content: bytes) -> Iterator[tuple[int, str | None, bytes]]:
    """(offset, record id, record) of the records of a file; what does not parse up to the next record is one record without an id."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, mark = 0, b"WARC/"
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        lines = data[at:head].split(b"\r\n")[1:] if head > 0 and data[at : at + len(mark)] == mark else []
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        try:
            end = head + 4 + int(fields[b"content-length"])
        except (KeyError, ValueError):
            end = -1
        name = fields.get(b"warc-record-id")
        if end < 0 or data[end : end + 4] != b"\r\n\r\n":
            nxt = data.find(b"\r\n\r\n" + mark, at + 1)
            end, name = nxt if nxt >= 0 else len(data) - 4 if data.endswith(b"\r\n\r\n") else len(data), None
        yield at, name.decode("utf-8", "replace").strip("<>") if name is not None else None, data[at:end]
        at = end + 4


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, content); a name without `file=N/` gets a number by hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    number = F.regexp_extract("path", r"file=(\d+)/", 1)
    return files.select(F.when(number != "", number.cast("bigint")).otherwise(F.xxhash64("path")).alias("file"), "content")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of the *.gz files under path, from their bytes."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                rows = [(file, at, key, len(r) + 4, hashlib.sha256(r).hexdigest()) for at, key, r in _parsed(content)]
                yield pd.DataFrame(rows, columns=["file", "offset", "record_id", "length", "sha256"])

    return _numbered(_files(spark, path).mapInPandas(parse, "file bigint, offset bigint, record_id string, length bigint, sha256 string"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, record_id, length, last, record) of the *.gz files under path; last marks a file's last record."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                rows = [(file, at, key, len(r) + 4, False, r.decode("utf-8", "replace")) for at, key, r in _parsed(content)]
                if rows:
                    rows[-1] = (*rows[-1][:4], True, rows[-1][5])
                yield pd.DataFrame(rows, columns=["file", "offset", "record_id", "length", "last", "record"])

    return _files(spark, path).mapInPandas(parse, "file bigint, offset bigint, record_id string, length bigint, last boolean, record string")


def write_damaged(spark: SparkSession, path: str, out: str, parts: int = 97) -> None:
    """A replica of the files under path with damage for rehearsals of an audit, chosen by the hash of a record: of `parts` records
    one gets another date, one is written again at the end of its file, and one changes places with the next; each file loses its last record.

    A file is read, changed and written by one task."""
    rows = read_records(spark, path)
    pick = F.conv(F.substring(F.sha2("record", 256), 57, 8), 16, 10).cast("bigint") % parts
    end = F.lit(1 << 40)
    places = F.when(pick == 1, F.array(F.col("offset"), end + F.col("offset"))).when(pick == 2, F.array(F.col("offset") + F.col("length") + 1)).otherwise(F.array("offset"))
    changed = F.when(pick == 0, F.replace("record", F.lit("WARC-Date: 1970"), F.lit("WARC-Date: 1971"))).otherwise(F.col("record"))
    moved = rows.where("not last").select("file", changed.alias("record"), F.explode(places).alias("at"))
    _write(moved.sortWithinPartitions("file", "at"), out)


def _node(children: DataFrame, keys: list, line: Column, order: str) -> DataFrame:
    """Nodes with the hash of their children's lines in order; children are bounded by the fanout or by the records of a range."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    return children.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))


def levels(records: DataFrame, n_files: int, most: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (file, node, hash), from offset ranges up to the root; above files, `file` is -1 and nodes are groups of files."""
    line = F.concat_ws(":", "offset", "length", "sha256")
    out = [_node(records.withColumn("node", F.floor(F.col("offset") / range_bytes)), ["file", "node"], line, "offset")]
    ranges = most // range_bytes + 1
    while ranges > 1:
        out.append(_node(out[-1].withColumn("up", F.floor(F.col("node") / fanout)), ["file", "up"], F.col("hash"), "node").withColumnRenamed("up", "node"))
        ranges = -(-ranges // fanout)
    top = out[-1].select(F.lit(-1).cast("bigint").alias("file"), F.col("file").alias("node"), "hash")
    out.append(top)
    while n_files > 1:
        out.append(_node(out[-1].withColumn("up", F.floor(F.col("node") / fanout)), ["file", "up"], F.col("hash"), "node").withColumnRenamed("up", "node"))
        n_files = -(-n_files // fanout)
    return out


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    one = a.join(b.withColumnRenamed("hash", "other"), ["file", "node"], "full_outer")
    return one.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")


def differing_ranges(a: list[DataFrame], b: list[DataFrame], n_files: int, fanout: int = FANOUT) -> DataFrame:
    """(file, node) of the offset ranges that differ: from the roots down, only below nodes that differ. Ends at the first level without any."""
    files_at = len(a) - _file_levels(n_files, fanout)  # the level whose nodes are files
    found = written(_differing(a[-1], b[-1]))
    for level in range(len(a) - 2, -1, -1):
        if found.isEmpty():
            break
        if level == files_at - 1:  # from a file to its own top node
            below = lambda x: x.join(found.select(F.col("node").alias("file")), "file", "left_semi")
        else:
            up = found.withColumnRenamed("node", "up")
            below = lambda x: x.withColumn("up", F.floor(F.col("node") / fanout)).join(up, ["file", "up"], "left_semi").drop("up")
        found = written(_differing(below(a[level]), below(b[level])))
    return found


def _file_levels(n_files: int, fanout: int) -> int:
    n = 1
    while n_files > 1:
        n, n_files = n + 1, -(-n_files // fanout)
    return n


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """One row per record of the primary's manifest, and per record that only the replica has: file, offset, record_id, copy, length, sha256, status (ok, moved, corrupt, missing, extra)."""
    size = primary.unionByName(replica).agg(F.max("file"), F.max("offset")).first()
    n_files, most = (size[0] if size[0] is not None else 0) + 1, size[1] or 0
    trees = [[written(x) for x in levels(side, n_files, most, range_bytes, fanout)] for side in (primary, replica)]
    bad = differing_ranges(*trees, n_files, fanout)
    ranged = lambda x: x.withColumn("node", F.floor(F.col("offset") / range_bytes))
    fine = ranged(primary).join(bad, ["file", "node"], "left_anti").drop("node").withColumn("status", F.lit("ok"))
    suspect = ranged(primary).join(bad, ["file", "node"], "left_semi").drop("node")
    # A record may have moved to another range of its file, so it is looked for among the replica's differing ranges of any place.
    other = ranged(replica).join(bad, ["file", "node"], "left_semi")
    keys = ["file", "record_id", "copy"]
    other = other.select(*keys, F.col("offset").alias("offset2"), F.col("length").alias("length2"), F.col("sha256").alias("sha2562"))
    both = suspect.join(other, keys, "full_outer")
    status = (
        F.when(F.col("sha256").isNull(), "extra").when(F.col("sha2562").isNull(), "missing").when(F.col("sha256") != F.col("sha2562"), "corrupt").when(F.col("offset") != F.col("offset2"), "moved").otherwise("ok")
    )
    checked = both.select("file", F.coalesce("offset", "offset2").alias("offset"), "record_id", "copy", F.coalesce("length", "length2").alias("length"), F.coalesce("sha256", "sha2562").alias("sha256"), status.alias("status"))
    return fine.select(checked.columns).unionByName(checked)


def root(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(hash) of the tree's root; no row for no records."""
    size = records.agg(F.max("file"), F.max("offset")).first()
    if size[0] is None:
        return levels(records, 1, 0, range_bytes, fanout)[-1].select("hash")
    return levels(records, size[0] + 1, size[1], range_bytes, fanout)[-1].select("hash")
