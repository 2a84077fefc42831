"""DICOM files: headers, series, an index that is kept up to date, pixels, overlays, members of zip archives, and a writer of image planes.

Uncompressed little-endian files with explicit or implicit value types are read.
Spark lists and reads the files; a small function finds a file's elements. A file
that cannot be read has a header row with an error and no pixels; it stops nothing.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tags of the elements that headers give.
TAGS = {
    "series_uid": (0x0020, 0x000E), "series_number": (0x0020, 0x0011), "description": (0x0008, 0x103E), "instance": (0x0020, 0x0013), "time": (0x0018, 0x1060),
    "position": (0x0020, 0x0032), "orientation": (0x0020, 0x0037), "spacing": (0x0028, 0x0030), "slope": (0x0028, 0x1053), "intercept": (0x0028, 0x1052),
    "rows": (0x0028, 0x0010), "cols": (0x0028, 0x0011), "bits": (0x0028, 0x0100), "signed": (0x0028, 0x0103),
}
PIXELS, OVERLAY_ROWS, OVERLAY_COLS, OVERLAY = (0x7FE0, 0x0010), (0x6000, 0x0010), (0x6000, 0x0011), (0x6000, 0x3000)
#: Value types with four bytes of length, and of 16-bit numbers.
LONG, SHORT = {b"OB", b"OW", b"OF", b"SQ", b"UT", b"UN", b"UC", b"UR", b"OD", b"OL"}, {b"US", b"SS"}
IMPLICIT = "1.2.840.10008.1.2"
#: Transfer syntaxes that are read: little-endian, implicit or explicit.
PLAIN = (IMPLICIT, "1.2.840.10008.1.2.1")
#: What damaged files raise.
DAMAGE = (struct.error, ValueError, IndexError, KeyError, OverflowError, UnicodeDecodeError, zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError)


def elements(data: bytes) -> dict[tuple[int, int], bytes] | None:
    """The values of a file's elements by tag; None if it is no DICOM file."""
    if data[128:132] != b"DICM":
        return None
    found, at, explicit = {}, 132, True
    while at + 8 <= len(data):
        tag = struct.unpack_from("<2H", data, at)
        if tag[0] != 2 and found.get((2, 0x10), b"").rstrip(b"\0 ").decode() == IMPLICIT:
            explicit = False
        kind = data[at + 4 : at + 6]
        if not explicit:
            size, at = struct.unpack_from("<I", data, at + 4)[0], at + 8
        elif kind in LONG:
            size, at = struct.unpack_from("<I", data, at + 8)[0], at + 12
        else:
            size, at = struct.unpack_from("<H", data, at + 6)[0], at + 8
        if size == 0xFFFFFFFF:  # up to the end of the sequence
            end = data.find(b"\xfe\xff\xdd\xe0\0\0\0\0", at)
            size = (end + 8 if end >= 0 else len(data)) - at
        if at + size > len(data):
            raise ValueError(f"element {tag[0]:04x},{tag[1]:04x} ends {at + size - len(data)} bytes behind the file")
        found[tag] = data[at : at + size]
        at += size
    syntax = found.get((2, 0x10), IMPLICIT.encode()).rstrip(b"\0 ").decode()
    if syntax not in PLAIN:
        raise ValueError(f"transfer syntax {syntax} is not read")
    return found


def header(found: dict) -> dict:
    text = lambda k: found[TAGS[k]].rstrip(b"\0 ").decode("latin-1") if TAGS[k] in found else None
    numbers = lambda k: [float(v) for v in (text(k) or "").split("\\") if v.strip()] or None
    one = lambda k, other=None: (numbers(k) or [other])[0]
    short = lambda k, other=0: struct.unpack_from("<H", found[TAGS[k]])[0] if TAGS[k] in found else other
    return {
        "series_uid": text("series_uid"), "series_number": one("series_number"), "description": text("description"), "instance": one("instance"), "time": one("time"),
        "position": numbers("position"), "orientation": numbers("orientation"), "spacing": numbers("spacing"), "slope": one("slope", 1.0), "intercept": one("intercept", 0.0),
        "rows": short("rows"), "cols": short("cols"), "bits": short("bits", 16), "signed": short("signed"),
    }


HEADER = "file string, series_uid string, series_number double, description string, instance double, time double, position array<double>, orientation array<double>, spacing array<double>, slope double, intercept double, rows int, cols int, bits int, signed int, error string"
FIELDS = [c.split()[0] for c in HEADER.split(", ")]


def _contents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _members(file: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """The file itself, or the members of a zip archive."""
    if content[:2] != b"PK":
        yield file, content
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            yield f"{file}/{name}", z.read(name)


def _header_rows(name: str, content: bytes) -> list[dict]:
    """The headers of a file or of the members of an archive, with an error where there is one; none for what is no DICOM file."""
    rows = []
    try:
        for member, data in _members(name, content):
            try:
                found = elements(data)
                if found is not None:
                    rows.append({"file": member} | header(found))
            except DAMAGE as e:
                rows.append({"file": member, "error": f"{type(e).__name__}: {e}"})
    except DAMAGE as e:
        rows.append({"file": name, "error": f"{type(e).__name__}: {e}"})
    return rows


def _read_headers(extra: list[str]):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r | {k: at[k] for k in extra} for at in pdf.to_dict("records") for r in _header_rows(at["file"], bytes(at["content"]))]
            if rows:
                yield pd.DataFrame([[r.get(c) for c in (*FIELDS, *extra)] for r in rows], columns=[*FIELDS, *extra], dtype=object)

    return read


def headers(spark: SparkSession, path: str) -> DataFrame:
    """HEADER of every DICOM file below a path, also in zip archives; files of other kinds are passed over, damaged ones have an error."""
    return _contents(spark, path).mapInPandas(_read_headers([]), HEADER)


INDEX = f"{HEADER}, path string, length bigint, modified timestamp, scan int"
#: Changed files that are read by their names; beyond that, by the time of the oldest.
BY_NAME = 1000


def _listed(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def scan(spark: SparkSession, path: str, before: DataFrame | None = None) -> DataFrame:
    """INDEX of all files below a path: one row a DICOM file or member, one with null columns for a file of another kind.

    With the index of an earlier scan, only files that are new or have another length or time are read; what is gone
    leaves the index, the rest keeps its rows. Listing files reads none of them. `scan` counts the scans until a file was
    read. Up to BY_NAME changed files are read by their names; if there are more, all files as new as the oldest of them."""
    listed = _listed(spark, path).select("path", "length", F.col("modificationTime").alias("modified"))
    key = ["path", "length", "modified"]
    number = 0
    changed = listed
    if before is not None:
        number = (before.agg(F.max("scan")).first()[0] or 0) + 1
        changed = listed.join(before.select(*key).distinct(), key, "left_anti")
    names = [r.path for r in changed.select("path").limit(BY_NAME + 1).collect()]
    if not names and before is not None:
        return before.join(listed, key, "left_semi").select(before.columns)
    if 0 < len(names) <= BY_NAME and not any(c in n for n in names for c in "*?[]{},\\"):
        read = _listed(spark, names)
    else:
        oldest = changed.agg(F.min("modified")).first()[0]
        read = _listed(spark, path) if oldest is None else _listed(spark, path).where(F.col("modificationTime") >= F.lit(oldest))
    read = read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "path", "length", F.col("modificationTime").alias("modified"), "content")
    read = read.join(changed, key, "left_semi")
    found = read.select("file", "path", "content").mapInPandas(_read_headers(["path"]), f"{HEADER}, path string")
    new = changed.join(found, "path", "left").withColumn("scan", F.lit(number))
    new = new.select(*FIELDS, "path", "length", "modified", "scan")
    return new if before is None else before.join(listed, key, "left_semi").select(new.columns).unionByName(new)


def series(headers: DataFrame) -> DataFrame:
    """(series_uid, series_number, description, n, files): files in the order of their instance and time; files with an error are in none."""
    order = F.array_sort(F.collect_list(F.struct("instance", "time", "file")))
    found = headers.where("error is null and series_uid is not null")
    return found.groupBy("series_uid").agg(F.min("series_number").alias("series_number"), F.min("description").alias("description"), F.count("*").alias("n"), F.transform(order, lambda x: x["file"]).alias("files"))


def series_images(headers: DataFrame) -> DataFrame:
    """(series_uid, file, slice, step, ts): a series as one image object. Slices are the different places along the first
    image's normal, from the lowest; steps are the images of a slice by time and instance. Times of steps under one unit
    apart on average are taken for seconds and become milliseconds; without a time, ts is the step."""
    found = headers.where("error is null and series_uid is not null and position is not null")
    a = F.first("orientation").over(Window.partitionBy("series_uid").orderBy("instance", "file").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    o = lambda k: F.coalesce(F.get("_o", k), F.lit([1.0, 0.0, 0.0, 0.0, 1.0, 0.0][k]))
    normal = [o(1) * o(5) - o(2) * o(4), o(2) * o(3) - o(0) * o(5), o(0) * o(4) - o(1) * o(3)]
    along = sum(normal[k] * F.get("position", k) for k in range(3))
    placed = found.withColumn("_o", a).withColumn("_along", F.round(along, 4))
    placed = placed.withColumn("slice", F.dense_rank().over(Window.partitionBy("series_uid").orderBy("_along")) - 1)
    stack = Window.partitionBy("series_uid", "slice").orderBy("time", "instance", "file")
    placed = placed.withColumns({"step": F.row_number().over(stack) - 1, "_gap": F.col("time") - F.lag("time").over(stack)})
    seconds = F.coalesce(F.avg("_gap").over(Window.partitionBy("series_uid")) < 1, F.lit(False))
    ts = F.coalesce(F.when(seconds, F.col("time") * 1000).otherwise(F.col("time")), F.col("step").cast("double"))
    return placed.withColumn("ts", ts).select("series_uid", "file", "slice", "step", "ts")


def pixels(spark: SparkSession, path: str, crop: tuple[int, int, int, int] | None = None, overlay: bool = False) -> DataFrame:
    """(file, row, col, val): rescaled pixels, or the bits of the overlay plane; crop (first row, row after the last, the same for columns) is cut while a file is read. Damaged and compressed files have none: their header rows tell why."""

    def plane(data: bytes) -> np.ndarray | None:
        found = elements(data)
        if found is None or (OVERLAY if overlay else PIXELS) not in found:
            return None
        h = header(found)
        if overlay:
            n, m = (struct.unpack_from("<H", found[t])[0] for t in (OVERLAY_ROWS, OVERLAY_COLS))
            return np.unpackbits(np.frombuffer(found[OVERLAY], np.uint8), bitorder="little")[: n * m].reshape(n, m).astype(float)
        kind = f"<{'i' if h['signed'] else 'u'}{h['bits'] // 8}"
        return np.frombuffer(found[PIXELS], kind, h["rows"] * h["cols"]).reshape(h["rows"], h["cols"]) * h["slope"] + h["intercept"]

    def planes(file: str, content: bytes) -> Iterator[tuple[str, np.ndarray]]:
        try:
            for name, data in _members(file, content):
                try:
                    grid = plane(data)
                except DAMAGE:  # its header row tells
                    continue
                if grid is not None:
                    yield name, grid
        except DAMAGE:
            return

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                for name, grid in planes(file, bytes(content)):
                    a, b, c, d = crop or (0, grid.shape[0], 0, grid.shape[1])
                    part = grid[a:b, c:d]
                    row, col = np.indices(part.shape)
                    yield pd.DataFrame({"file": name, "row": row.ravel() + a, "col": col.ravel() + c, "val": part.ravel()})

    return _contents(spark, path).mapInPandas(read, "file string, row int, col int, val double")


def encode(h: dict, vals: np.ndarray, bits: np.ndarray | None = None, tags: dict[tuple[int, int], tuple[bytes, bytes]] | None = None) -> bytes:
    """A DICOM file of one plane of whole values, of 16 bits or, where these do not hold them, 32, signed if one is negative, with an overlay plane if given, and with further elements: tags to value type and bytes."""
    pad = lambda v, c=b" ": v + c * (len(v) % 2)
    numbers = lambda v: "\\".join(f"{x:.10g}" for x in v).encode()

    def element(tag, kind: bytes, value: bytes) -> bytes:
        size = struct.pack("<HI", 0, len(value)) if kind in LONG else struct.pack("<H", len(value))
        return struct.pack("<2H", *tag) + kind + size + value

    texts = {"description": (b"LO", h["description"].encode("latin-1")), "time": (b"DS", numbers([h["time"]])), "series_uid": (b"UI", h["series_uid"].encode()), "series_number": (b"IS", str(int(h["series_number"])).encode()), "instance": (b"IS", str(int(h["instance"])).encode()), "position": (b"DS", numbers(h["position"])), "orientation": (b"DS", numbers(h["orientation"])), "spacing": (b"DS", numbers(h["spacing"])), "intercept": (b"DS", numbers([h["intercept"]])), "slope": (b"DS", numbers([h["slope"]]))}
    parts = {TAGS[k]: element(TAGS[k], kind, pad(v, b"\0" if kind == b"UI" else b" ")) for k, (kind, v) in texts.items()}
    vals = np.asarray(vals, float)
    signed = int(vals.min(initial=0) < 0)
    bits_of = next((n for n in (16, 32) if vals.min(initial=0) >= -signed * 2.0 ** (n - 1) and vals.max(initial=0) < 2.0 ** (n - signed)), None)
    if bits_of is None:
        raise ValueError("the values of a plane need more than 32 bits")
    for k, v in {"rows": h["rows"], "cols": h["cols"], "bits": bits_of, "signed": signed}.items():
        parts[TAGS[k]] = element(TAGS[k], b"US", struct.pack("<H", v))
    for tag, (kind, value) in (tags or {}).items():
        parts[tag] = element(tag, kind, pad(value, b"\0" if kind == b"UI" else b" "))
    if bits is not None:
        parts[OVERLAY_ROWS], parts[OVERLAY_COLS] = (element(t, b"US", struct.pack("<H", v)) for t, v in ((OVERLAY_ROWS, h["rows"]), (OVERLAY_COLS, h["cols"])))
        parts[OVERLAY] = element(OVERLAY, b"OW", pad(np.packbits(np.asarray(bits, np.uint8), bitorder="little").tobytes(), b"\0"))
    parts[PIXELS] = element(PIXELS, b"OW", pad(vals.astype(f"<{'i' if signed else 'u'}{bits_of // 8}").tobytes(), b"\0"))
    meta = element((2, 0x10), b"UI", pad(b"1.2.840.10008.1.2.1", b"\0"))
    return b"\0" * 128 + b"DICM" + meta + b"".join(parts[k] for k in sorted(parts))


def planes(df: DataFrame, tags: dict[tuple[int, int], tuple[bytes, bytes]] | None = None) -> DataFrame:
    """(file, content) of planes: HEADER columns but bits and signed, with vals and overlay (arrays of rows × cols values, overlay may be null). tags are written to every file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file": pdf.file, "content": [encode(r, r["vals"], r["overlay"], tags) for r in pdf.to_dict("records")]})

    return df.mapInPandas(run, "file string, content binary")
