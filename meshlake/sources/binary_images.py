"""Binary image formats as (file, x, y, z, t, val): MetaImage, NIfTI-1, NRRD and raw matrices.

Spark lists and reads the files; one small function per format turns the bytes of
a file into its header and flat values, one batch of volumes at a time.

World coordinates are millimetres with x to the patient's left, y to the back and
z upward, as MetaImage and DICOM have them; NIfTI's x and y are negated. `direction`
has nine numbers, row by row, of the matrix whose columns are the world directions
of the three axes: the voxel (i, j, k) lies at origin + direction × (spacing × (i, j, k)).
Times are milliseconds: `start` is that of the first step, `interval` that between steps.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Type names of MetaImage, type codes of NIfTI-1 and type names of NRRD.
META_TYPES = {"MET_CHAR": "i1", "MET_UCHAR": "u1", "MET_SHORT": "i2", "MET_USHORT": "u2", "MET_INT": "i4", "MET_UINT": "u4", "MET_FLOAT": "f4", "MET_DOUBLE": "f8"}
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
NRRD_TYPES = {"uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "float": "f4", "double": "f8"}
VOLUME = "file string, shape array<int>, spacing array<double>, origin array<double>, vals array<double>, direction array<double>, start double, interval double"
UPRIGHT = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
#: Codes of NIfTI-1 for units of space, as millimetres, and of time, as milliseconds.
SPACE_UNITS = {1: 1000.0, 2: 1.0, 3: 0.001}
TIME_UNITS = {8: 1000.0, 16: 1.0, 24: 0.001}


def metaimage(content: bytes) -> tuple:
    head, _, data = content.partition(b"ElementDataFile")
    fields = dict((k.strip(), v.strip()) for k, _, v in (line.partition("=") for line in head.decode().splitlines()) if v)
    data = data.split(b"\n", 1)[1]
    if fields.get("CompressedData", "False").lower() == "true":
        data = zlib.decompress(data)
    shape = [int(v) for v in fields["DimSize"].split()]
    order = ">" if fields.get("BinaryDataByteOrderMSB", "False").lower() == "true" else "<"
    numbers = lambda *names: [float(v) for n in names if n in fields for v in fields[n].split()][: len(shape)]
    spacing, origin = numbers("ElementSpacing") or [1.0] * len(shape), numbers("Offset", "Position", "Origin") or [0.0] * len(shape)
    # One triple (or quadruple, with time) of numbers an axis.
    named = next((fields[n].split() for n in ("TransformMatrix", "Rotation", "Orientation") if n in fields), None)
    direction = UPRIGHT
    if named:
        wide = int(round(len(named) ** 0.5))
        axes = np.eye(3)
        axes[: min(3, wide), : min(3, wide)] = np.array(named, float).reshape(wide, wide)[:3, :3]
        direction = axes.T.ravel().tolist()
    times = (origin[3] * 1000, spacing[3] * 1000) if len(shape) == 4 else (0.0, 1000.0)
    return shape, spacing, origin, np.frombuffer(data, order + META_TYPES[fields["ElementType"]], int(np.prod(shape))), direction, *times


def quaternion_matrix(b: float, c: float, d: float) -> np.ndarray:
    """The rotation of a unit quaternion whose first part is not negative and left out."""
    a = max(0.0, 1.0 - b * b - c * c - d * d) ** 0.5
    n = (a * a + b * b + c * c + d * d) ** 0.5
    a, b, c, d = a / n, b / n, c / n, d / n
    return np.array([[1 - 2 * (c * c + d * d), 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), 1 - 2 * (b * b + d * d), 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), 1 - 2 * (b * b + c * c)]])


def nifti(content: bytes) -> tuple:
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    order = "<" if struct.unpack("<i", data[:4])[0] == 348 else ">"
    dims = struct.unpack(order + "8h", data[40:56])
    shape = [max(1, n) for n in dims[1 : 1 + dims[0]]]
    kind = struct.unpack(order + "h", data[70:72])[0]
    spacing = struct.unpack(order + "8f", data[76:108])[1 : 1 + len(shape)]
    at, slope, inter = struct.unpack(order + "3f", data[108:120])
    qform, sform, b, c, d, x, y, z = struct.unpack(order + "2h6f", data[252:280])
    rows = np.array(struct.unpack(order + "12f", data[280:328])).reshape(3, 4)
    qfac = -1.0 if struct.unpack(order + "f", data[76:80])[0] < 0 else 1.0
    sizes = np.array([*spacing, 1.0, 1.0, 1.0])[:3]
    if qform > 0 or sform <= 0:
        turned = quaternion_matrix(b, c, d) * [1.0, 1.0, qfac] if qform > 0 else np.diag([-1.0, -1.0, 1.0])
        place = np.array([x, y, z])
    else:
        turned, place = rows[:, :3] / np.where(sizes != 0, sizes, 1.0), rows[:, 3]
    unit = SPACE_UNITS.get(data[123] & 7, 1.0)
    interval = float(struct.unpack(order + "f", data[92:96])[0]) or 1.0
    # Without a unit, steps under one are taken for seconds, and over a thousand for microseconds.
    ticks = TIME_UNITS.get(data[123] & 56, 1000.0 if interval < 1 else 0.001 if interval > 1000 else 1.0)
    start = struct.unpack(order + "f", data[136:140])[0] * ticks
    direction = (np.diag([-1.0, -1.0, 1.0]) @ turned).ravel().tolist()
    origin = (np.array([-1.0, -1.0, 1.0]) * place * unit).tolist()
    spacing = [v * unit if k < 3 else v for k, v in enumerate(spacing)]
    vals = np.frombuffer(data, order + NIFTI_TYPES[kind], int(np.prod(shape)), int(at)).astype(float)
    if slope not in (0.0, 1.0) or inter:
        vals = vals * (slope or 1.0) + inter
    return shape, [float(v) for v in spacing], origin, vals, direction, start, interval * ticks


def nrrd(content: bytes) -> tuple:
    head, _, data = content.partition(b"\n\n")
    fields = dict(line.split(": ", 1) for line in head.decode().splitlines() if ": " in line and line[0] != "#")
    if fields.get("encoding", "raw") in ("gzip", "gz"):
        data = gzip.decompress(data)
    shape = [int(v) for v in fields["sizes"].split()]
    order = ">" if fields.get("endian") == "big" else "<"
    spacing = [float(v) for v in fields["spacings"].split()] if "spacings" in fields else [1.0] * len(shape)
    origin = [float(v) for v in fields["space origin"].strip("()").split(",")] if "space origin" in fields else [0.0] * len(shape)
    # NRRD gives a vector an axis, with the spacing as its length; spaces whose first axes run to the right or front are turned.
    direction = UPRIGHT
    vectors = [np.array([float(v) for v in t.strip("()").split(",")]) for t in fields.get("space directions", "").split() if t != "none"]
    if len(vectors) == 3 and all(len(v) == 3 for v in vectors):
        lengths = [float(np.linalg.norm(v)) or 1.0 for v in vectors]
        spacing = [*lengths, *spacing[3:]]
        space = fields.get("space", "").lower()
        flip = np.array([-1.0 if space.startswith("right") or space[:1] == "r" else 1.0, -1.0 if "anterior" in space or space[1:2] == "a" else 1.0, 1.0])
        direction = (np.column_stack([v / n for v, n in zip(vectors, lengths)]) * flip[:, None]).ravel().tolist()
        origin = (np.array(origin[:3]) * flip).tolist()
    return shape, spacing, origin, np.frombuffer(data, order + NRRD_TYPES[fields["type"]], int(np.prod(shape))), direction, 0.0, 1.0


FORMATS: dict[str, Callable[[bytes], tuple]] = {"metaimage": metaimage, "nifti": nifti, "nrrd": nrrd}


def volumes(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One row per file: shape with x first, spacing, origin, values with x fastest, direction, start and interval."""
    parse = FORMATS[kind]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                shape, spacing, origin, vals, direction, start, interval = parse(bytes(content))
                yield pd.DataFrame({"file": [file], "shape": [shape], "spacing": [spacing], "origin": [origin], "vals": [np.asarray(vals, float)], "direction": [direction], "start": [start], "interval": [interval]})

    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return found.mapInPandas(read, VOLUME)


def pixels(volume: DataFrame) -> DataFrame:
    """(file, x, y, z, t, val) of volumes; absent axes are 0."""
    size = lambda k: F.coalesce(F.get("shape", k), F.lit(1))
    wide = volume.select("file", "shape", F.posexplode("vals").alias("i", "val"))
    nx, ny, nz = size(0), size(1), size(2)
    i = F.col("i")
    at = {"x": i % nx, "y": F.floor(i / nx) % ny, "z": F.floor(i / (nx * ny)) % nz, "t": F.floor(i / (nx * ny * nz))}
    return wide.select("file", *(c.cast("int").alias(k) for k, c in at.items()), "val")


def placed_pixels(volume: DataFrame) -> DataFrame:
    """(file, x, y, z, t, val, p, ts): pixels with their place in the world and their time."""
    at = pixels(volume).join(volume.select("file", "spacing", "origin", "direction", "start", "interval"), "file")
    step = lambda k: F.col("xyz"[k]) * F.coalesce(F.get("spacing", k), F.lit(1.0))
    place = [F.coalesce(F.get("origin", i), F.lit(0.0)) + sum(F.get("direction", 3 * i + k) * step(k) for k in range(3)) for i in range(3)]
    return at.select("file", "x", "y", "z", "t", "val", F.struct(*(c.alias(k) for k, c in zip("xyz", place))).alias("p"), (F.col("start") + F.col("t") * F.col("interval")).alias("ts"))


def raw_matrix(spark: SparkSession, path: str, dtype: str, width: int, skip: int = 0) -> DataFrame:
    """(file, row_id, vals) of typed byte streams, for instance `<f4` or `>i2`, after so many bytes."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                flat = np.frombuffer(bytes(content), dtype, offset=skip).astype(float)
                rows = flat[: len(flat) // width * width].reshape(-1, width)
                yield pd.DataFrame({"file": file, "row_id": np.arange(len(rows)), "vals": list(rows)})

    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return found.mapInPandas(read, "file string, row_id bigint, vals array<double>")
