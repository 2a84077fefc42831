"""Arrays in XML: VTK XML files in all their encodings, and X4DF containers of meshes that change over time.

Spark lists and reads the files. One pass over a file's XML gives a row for each
array, still encoded; arrays in side files are joined to their rows; then tasks
decode arrays one by one. No row of a table holds more than one array.
"""

from __future__ import annotations

import base64
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text_meshes import _write_lines

#: Number types of VTK XML.
VTK_TYPES = {"Int8": "i1", "UInt8": "u1", "Int16": "i2", "UInt16": "u2", "Int32": "i4", "UInt32": "u4", "Int64": "i8", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}
ROWS = "row_id bigint, vals array<double>"
#: Rows of an array that leave a task at once.
BATCH = 1 << 16


def _row_frames(values: np.ndarray, width: int) -> Iterator[pd.DataFrame]:
    rows = np.asarray(values, float)[: len(values) // width * width].reshape(-1, width)
    for a in range(0, len(rows), BATCH):
        part = rows[a : a + BATCH]
        yield pd.DataFrame({"row_id": np.arange(a, a + len(part)), "vals": list(part)})


# VTK XML


def vtk_block(text: bytes, dtype: str, header: str, compressed: bool) -> np.ndarray:
    """The numbers of a base64 block: sizes first, then the data, compressed in pieces or as a whole."""
    text = re.sub(rb"\s+", b"", text)
    size = np.dtype(header).itemsize

    def numbers(n: int) -> np.ndarray:
        return np.frombuffer(base64.b64decode(text[: -(-n * size // 3) * 4]), header, n)

    if not compressed:
        n = int(numbers(1)[0])
        # Header and data are one base64 text, or one each.
        whole = base64.b64decode(text) if b"=" not in text[:-2] else b"".join(base64.b64decode(t) for t in _padded_parts(text))
        return np.frombuffer(whole, np.dtype(dtype), n // np.dtype(dtype).itemsize, size)
    pieces = int(numbers(1)[0])
    head = numbers(3 + pieces)
    data = base64.b64decode(text[-(-(3 + pieces) * size // 3) * 4 :])
    ends = np.concatenate([[0], np.cumsum(head[3:]).astype(np.int64)])
    return np.frombuffer(b"".join(zlib.decompress(data[a:b]) for a, b in zip(ends, ends[1:])), dtype)


def _padded_parts(text: bytes) -> list[bytes]:
    return [m for m in re.findall(rb"[^=]+={0,2}", text)]


def _vtk_arrays(content: bytes) -> Iterator[tuple]:
    """(section, name, components, type, values) of every DataArray, in the order of the file."""
    order, header, compressed, parents, offset = "<", "u4", False, [], b""
    found = []
    appended = content.find(b"<AppendedData")
    xml, raw = content, b""
    if appended >= 0:
        start = content.index(b"_", appended) + 1
        raw = content[start : content.rindex(b"</AppendedData>")]
        xml = content[:appended] + b"</VTKFile>"
        encoding = re.search(rb'encoding="(\w+)"', content[appended:start])
        offset = encoding[1] if encoding else b"base64"
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        if event == "start":
            parents.append(e.tag)
            if e.tag == "VTKFile":
                order = ">" if e.get("byte_order") == "BigEndian" else "<"
                header = {"UInt64": "u8"}.get(e.get("header_type", "UInt32"), "u4")
                compressed = bool(e.get("compressor"))
            continue
        parents.pop()
        if e.tag == "DataArray":
            kind = order + VTK_TYPES[e.get("type", "Float64")]
            form = e.get("format", "ascii")
            if form == "ascii":
                values = np.array((e.text or "").split(), float)
            elif form == "binary":
                values = vtk_block((e.text or "").encode(), kind, order + header, compressed)
            else:
                values = _appended(raw[int(e.get("offset", 0)) :], kind, order + header, compressed, offset)
            found.append((parents[-1] if parents else "", e.get("Name") or parents[-1], int(e.get("NumberOfComponents") or 1), values))
            e.clear()
    return iter(found)


def _appended(data: bytes, kind: str, header: str, compressed: bool, encoding: bytes) -> np.ndarray:
    if encoding == b"base64":
        size = np.dtype(header).itemsize
        n = int(np.frombuffer(base64.b64decode(data[: -(-size // 3) * 4]), header, 1)[0])
        if not compressed:
            return vtk_block(data[: -(-(size + n) // 3) * 4], kind, header, False)
        sizes = np.frombuffer(base64.b64decode(data[: -(-(3 + n) * size // 3) * 4]), header, 3 + n)
        return vtk_block(data[: -(-(3 + n) * size // 3) * 4 + -(-int(sizes[3:].sum()) // 3) * 4], kind, header, True)
    n, size = int(np.frombuffer(data, header, 1)[0]), np.dtype(header).itemsize
    if not compressed:
        return np.frombuffer(data, kind, n // np.dtype(kind).itemsize, size)
    head = np.frombuffer(data, header, 3 + n)
    ends = size * (3 + n) + np.concatenate([[0], np.cumsum(head[3:]).astype(np.int64)])
    return np.frombuffer(b"".join(zlib.decompress(data[a:b]) for a, b in zip(ends, ends[1:])), kind)


def vtk_xml(spark: SparkSession, path: str) -> DataFrame:
    """(file, section, array, row_id, vals) of the DataArrays of VTK XML files: ASCII, base64, appended, compressed by zlib or not."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for file, content in zip(pdf.file, pdf.content):
                for section, name, width, values in _vtk_arrays(bytes(content)):
                    for rows in _row_frames(values, width):
                        yield rows.assign(file=file, section=section, array=name)[["file", "section", "array", "row_id", "vals"]]

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return found.mapInPandas(read, f"file string, section string, array string, {ROWS}")


# X4DF

#: How the numbers of an array are written: as text, as base64 or compressed before that, in the file or as bytes in a side file.
X4DF_FORMATS = ("ascii", "base64", "base64_gz", "binary", "binary_gz")
ARRAYS = "file string, mesh string, kind string, name string, number int, ts double, topology string, elem_type string, per_element boolean, initial string, src string, format string, type string, width int, side string, payload binary"


def encode_array(values: np.ndarray, form: str, dtype: str) -> bytes:
    data = np.ascontiguousarray(values).astype("<" + dtype).tobytes()
    if form == "ascii":
        return " ".join(repr(v) for v in np.asarray(values).astype(dtype).ravel().tolist()).encode()
    data = gzip.compress(data, 1, mtime=0) if form.endswith("_gz") else data
    return base64.b64encode(data) if form.startswith("base64") else data


def decode_array(data: bytes, form: str, dtype: str) -> np.ndarray:
    if form == "ascii":
        return np.array(data.split(), float)
    data = base64.b64decode(data) if form.startswith("base64") else data
    return np.frombuffer(gzip.decompress(data) if form.endswith("_gz") else data, "<" + dtype).astype(float)


def _x4df_arrays(file: str, content: bytes) -> list[dict]:
    """A row for every use of an array by the nodes, a topology or a field of a mesh, and for initial nodes."""
    uses, arrays, mesh, scheme, counts = [], {}, None, None, {}
    number = lambda v: None if v is None else float(v)
    for event, e in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            if e.tag == "mesh":
                mesh, counts = e.get("name"), {}
                scheme = [float(v) for v in e.get("timescheme").split()] if e.get("timescheme") else None
        elif e.tag in ("nodes", "field", "topology"):
            name = e.get("name") if e.tag != "nodes" else "nodes"
            k = counts[e.tag, name] = counts.get((e.tag, name), -1) + 1
            ts = number(e.get("timestep"))
            if ts is None and scheme and e.tag != "topology":
                ts = scheme[0] + k * scheme[1]
            row = {"kind": e.tag, "name": name, "number": k, "ts": ts, "src": e.get("src"), "initial": e.get("initialnodes"), "elem_type": e.get("elemtype")}
            uses.append({"mesh": mesh, "topology": e.get("toponame") or e.get("spatialtopology"), "per_element": e.get("fieldtype") == "elem" if e.tag == "field" else None} | row)
        elif e.tag == "array":
            shape = [int(v) for v in e.get("shape", "").split()]
            arrays[e.get("name")] = {"format": e.get("format", "ascii"), "type": e.get("type", "f8"), "width": int(np.prod(shape[1:])) if shape else 1, "side": e.get("filename"), "payload": (e.text or "").strip().encode()}
            e.clear()
    wanted = uses + [{"mesh": u["mesh"], "kind": "initial", "name": u["initial"], "number": 0, "src": u["initial"]} for u in {u["initial"]: u for u in uses if u["initial"]}.values()]
    return [{"file": file} | u | arrays[u["src"]] for u in wanted if u["src"] in arrays]


def x4df(spark: SparkSession, path: str) -> DataFrame:
    """(file, mesh, kind, name, number, ts, topology, elem_type, per_element, row_id, vals) of the meshes of X4DF files.

    kind is nodes, topology or field; number counts the time steps of nodes and of a field, one without steps is number 0
    of all; nodes include their initial nodes. Files are those that end in .x4df or lie in a folder name=…, as `write_x4df`
    leaves them; others are the side files that arrays name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    places = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), "path", "content")

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ARRAYS.split(", ")]
        for pdf in batches:
            for folder, file, content in zip(pdf.folder, pdf.file, pdf.content):
                rows = pd.DataFrame(_x4df_arrays(file, bytes(content)), columns=names)
                yield rows.assign(folder=folder)

    main = F.col("file").endswith(".x4df") | F.col("path").contains("/name=")
    described = places.where(main).select("folder", "file", "content").mapInPandas(describe, f"{ARRAYS}, folder string")
    sides = places.where(~main).select("folder", F.col("file").alias("side"), F.col("content").alias("_side"))
    whole = described.join(sides, ["folder", "side"], "left").withColumn("payload", F.coalesce("_side", "payload")).drop("_side", "folder")
    keep = ["file", "mesh", "kind", "name", "number", "ts", "topology", "elem_type", "per_element", "initial"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                for rows in _row_frames(decode_array(bytes(r["payload"]), r["format"], r["type"]), max(1, int(r["width"]))):
                    yield rows.assign(**{k: [r[k]] * len(rows) for k in keep})[[*keep, "row_id", "vals"]]

    kinds = dict(c.split() for c in ARRAYS.split(", "))
    rows = whole.mapInPandas(decode, ", ".join([f"{k} {kinds[k]}" for k in keep] + [ROWS]))
    first = rows.where("kind = 'initial'").select("file", "mesh", F.col("name").alias("initial"), "row_id", F.col("vals").alias("_first"))
    both = rows.where("kind <> 'initial'").join(first, ["file", "mesh", "initial", "row_id"], "left")
    moved = F.when(F.col("_first").isNull(), F.col("vals")).otherwise(F.zip_with("vals", "_first", lambda a, b: a + b))
    return both.withColumn("vals", moved).drop("initial", "_first")


def write_x4df(rows: DataFrame, path: str, form: str = "base64_gz", dtype: str = "f8") -> None:
    """Meshes (mesh, kind, name, number, ts, topology, elem_type, per_element, row_id, vals) as one X4DF file each, below path/name=…, with their arrays in it.

    An array is put together in one task; ts may be null for what has no time steps."""
    if form not in X4DF_FORMATS[:3]:
        raise ValueError(f"{form!r} needs side files; arrays are written into the file as one of {X4DF_FORMATS[:3]}")

    def put(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_id")
        r = pdf.iloc[0]
        values = np.array(pdf.vals.tolist(), float)
        kind = "u4" if r["kind"] == "topology" else dtype
        src = f"{r['kind']}_{r['name']}_{r['number']}"
        ts = "" if pd.isna(r.ts) else f' timestep="{float(r.ts)!r}"'
        told = {"nodes": f'<nodes src="{src}"{ts}/>', "topology": f'<topology name="{r["name"]}" src="{src}" elemtype="{r.elem_type}"/>', "field": f'<field name="{r["name"]}" src="{src}"{ts} toponame="{r.topology}" fieldtype="{"elem" if r.per_element else "node"}"/>'}
        array = f'<array name="{src}" shape="{values.shape[0]} {values.shape[1]}" type="{kind}" format="{form}">{encode_array(values, form, kind).decode()}</array>'
        order = {"nodes": 0, "topology": 1, "field": 2}[r["kind"]]
        return pd.DataFrame({"name": r.mesh, "part": [f"1{order}", "3"], "row_id": [int(r.number), int(r.number)], "line": [told[r["kind"]], array]})

    lines = rows.groupBy("mesh", "kind", "name", "number").applyInPandas(put, "name string, part string, row_id bigint, line string")
    names = rows.select(F.col("mesh").alias("name")).distinct()
    frame = lambda part, text: names.select("name", F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("row_id"), text.alias("line"))
    out = frame("0", F.concat(F.lit('<?xml version="1.0" encoding="utf-8"?>\n<x4df><mesh name="'), F.col("name"), F.lit('">'))).unionByName(lines)
    _write_lines(out.unionByName(frame("2", F.lit("</mesh>"))).unionByName(frame("4", F.lit("</x4df>"))), path)
