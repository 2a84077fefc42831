"""Files of binary formats from DataFrames: NIfTI-1, MetaImage and grey PNG slices.

An image object is one row (VOLUME of binary_images: shape, spacing, origin and
values with x fastest), because a file has to be put together somewhere; rows are
encoded and written by tasks, none by the driver. The folder must be one that all
executors see under the same path, as Spark has no sink for binary files.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .binary_images import META_TYPES, NIFTI_TYPES, UPRIGHT
from .binary_images import volumes as read_volumes


def volumes_of(pixels: DataFrame, key: str, shape: tuple[int, ...], spacing: tuple[float, ...], origin: tuple[float, ...]) -> DataFrame:
    """VOLUME rows of pixels (key, at, val), at counting with x fastest; absent ones are 0."""
    n = int(np.prod(shape))
    values = F.map_from_entries(F.collect_list(F.struct(F.col("at").cast("int"), "val")))
    out = pixels.groupBy(F.col(key).alias("file")).agg(values.alias("_m"))
    vals = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0)))
    arrays = {"shape": F.lit(list(shape)), "spacing": F.lit([float(v) for v in spacing]), "origin": F.lit([float(v) for v in origin])}
    return out.select(F.col("file").cast("string").alias("file"), *(c.alias(k) for k, c in arrays.items()), vals.alias("vals"))


def quaternion_of(turn: np.ndarray) -> tuple[float, float, float]:
    """The last three parts of the unit quaternion of a rotation, its first part made not negative."""
    trace = float(np.trace(turn))
    if trace > 0:
        a = (1 + trace) ** 0.5 / 2
        return tuple(float(turn[i, j] - turn[j, i]) / (4 * a) for i, j in ((2, 1), (0, 2), (1, 0)))
    k = int(np.argmax(np.diag(turn)))
    i, j = (k + 1) % 3, (k + 2) % 3
    q = np.zeros(3)
    q[k] = max(0.0, 1 + turn[k, k] - turn[i, i] - turn[j, j]) ** 0.5 / 2
    q[i], q[j] = (turn[k, i] + turn[i, k]) / (4 * q[k]), (turn[k, j] + turn[j, k]) / (4 * q[k])
    return tuple((q if turn[j, i] >= turn[i, j] else -q).tolist())


def nifti(shape, spacing, origin, vals, direction=UPRIGHT, start: float = 0.0, interval: float = 1.0, dtype: str = "f4") -> bytes:
    """A NIfTI-1 file in mm and ms: its quaternion and its matrix have the same place and direction, x and y negated."""
    head = bytearray(352)
    dims = [len(shape), *shape, *[1] * (7 - len(shape))]
    flip = np.diag([-1.0, -1.0, 1.0])
    turn = flip @ np.array(direction, float).reshape(3, 3)
    mirrored = np.linalg.det(turn) < 0
    steps = [-1.0 if mirrored else 1.0, *spacing, *[1.0] * (7 - len(spacing))]
    if len(shape) > 3:
        steps[4] = interval
    code = {v: k for k, v in NIFTI_TYPES.items()}[dtype]
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, *dims)
    struct.pack_into("<2h", head, 70, code, 8 * np.dtype(dtype).itemsize)
    struct.pack_into("<8f", head, 76, *steps)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<f", head, 136, start)
    head[123] = 2 | 16
    struct.pack_into("<2h", head, 252, 2, 1)
    place = flip @ np.array([*origin, 0.0, 0.0, 0.0][:3], float)
    struct.pack_into("<6f", head, 256, *quaternion_of(turn * [1.0, 1.0, -1.0 if mirrored else 1.0]), *place)
    rows = np.column_stack([turn * np.array(steps[1:4]), place])
    struct.pack_into("<12f", head, 280, *rows.ravel())
    head[344:348] = b"n+1\x00"
    return bytes(head) + np.asarray(vals).astype("<" + dtype).tobytes()


def metaimage(shape, spacing, origin, vals, direction=UPRIGHT, start: float = 0.0, interval: float = 1.0, dtype: str = "i2") -> bytes:
    """A MetaImage file with its data in it; times are in seconds."""
    kind = {v: k for k, v in META_TYPES.items()}[dtype]
    n = len(shape)
    spacing, origin = [*spacing, 1.0, 1.0, 1.0][:n], [*origin, 0.0, 0.0, 0.0][:n]
    if n > 3:
        spacing[3], origin[3] = interval / 1000, start / 1000
    axes = np.eye(n)
    axes[: min(3, n), : min(3, n)] = np.array(direction, float).reshape(3, 3).T[:n, :n]
    line = lambda v: " ".join(f"{x:.17g}" if isinstance(x, float) else str(x) for x in v)
    head = f"ObjectType = Image\nNDims = {n}\nBinaryData = True\nBinaryDataByteOrderMSB = False\nTransformMatrix = {line(axes.ravel().tolist())}\nOffset = {line(origin)}\nElementSpacing = {line(spacing)}\nDimSize = {line(shape)}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    return head.encode() + np.asarray(vals).astype("<" + dtype).tobytes()


def png(shape, spacing, origin, vals, direction=UPRIGHT, start: float = 0.0, interval: float = 1.0, stretch: bool = False) -> bytes:
    """A grey PNG of one slice; values are rounded and clamped to 0 to 255, or stretched so that its least is 0 and its greatest 255."""
    width, height = shape[:2]
    vals = np.asarray(vals, float)
    if stretch and len(vals):
        vals = (vals - vals.min()) * (255.0 / (np.ptp(vals) or 1.0))
    grey = np.clip(np.rint(vals), 0, 255).astype(np.uint8).reshape(height, width)
    lines = np.concatenate([np.zeros((height, 1), np.uint8), grey], 1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


ENCODERS: dict[str, Callable] = {"nifti": nifti, "metaimage": metaimage, "png": png}


def encoded(volumes: DataFrame, kind: str, **settings) -> DataFrame:
    """(file, content) of VOLUME rows; direction, start and interval may be absent."""
    encode = ENCODERS[kind]
    given = [c for c in ("direction", "start", "interval") if c in volumes.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"file": pdf.file, "content": [encode(r["shape"].tolist(), r["spacing"].tolist(), r["origin"].tolist(), r["vals"], **{c: r[c] for c in given}, **settings) for r in pdf.to_dict("records")]})

    return volumes.mapInPandas(run, "file string, content binary")


def write_binary(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Files of (file, content) below a folder that all executors see. A file is written under another name and renamed, so a repeated task leaves a whole one; one that was there before is refused unless overwrite is given. Tasks write with plain file access: a folder of another file system is refused."""
    scheme, _, rest = folder.partition(":")
    if "/" not in scheme and rest and scheme != "file":
        raise ValueError(f"tasks cannot write files to {folder!r}: give a folder that all executors have mounted")
    root = "/" + rest.lstrip("/") if scheme == "file" else folder
    os.makedirs(root, exist_ok=True)
    if not overwrite and os.listdir(root):
        raise FileExistsError(folder)

    def save(rows) -> None:
        os.makedirs(root, exist_ok=True)
        for r in rows:
            part = f"{root}/.{r.file}.{os.getpid()}"
            with open(part, "wb") as f:
                f.write(r.content)
            os.replace(part, f"{root}/{r.file}")

    df.foreachPartition(save)


def image_slices(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, col, val) of grey image files, read by Spark's own image source."""
    read = spark.read.format("image").load(path).select(F.element_at(F.split("image.origin", "/"), -1).alias("file"), "image.width", "image.nChannels", "image.data")
    cells = read.select("file", "width", F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("data") / F.col("nChannels")).cast("int") - 1), lambda k: F.conv(F.hex(F.substring("data", (k * F.col("nChannels") + 1).cast("int"), F.lit(1))), 16, 10).cast("double"))).alias("i", "val"))
    return cells.select("file", F.floor(F.col("i") / F.col("width")).cast("int").alias("row"), (F.col("i") % F.col("width")).alias("col"), "val")


def rewrite(spark: SparkSession, path: str, kind: str, out: str, change: Callable[[DataFrame], DataFrame], **settings) -> None:
    """Image files read, changed as a frame of VOLUME rows, and written under their names to another folder."""
    write_binary(encoded(change(read_volumes(spark, path, kind)), kind, **settings), out)
