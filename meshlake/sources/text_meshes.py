"""Text formats of meshes and fields as DataFrames, and back.

A file is one row of text; Spark splits it into numbered tokens or lines and a
projection gives them their meaning, so files are read in parallel and no Python
parses them. Indexes are 0-based in frames and 1-based on disk where the format
has it so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Sections of Medit files with the number of nodes of their elements.
MEDIT = {"Vertices": 0, "Edges": 2, "Triangles": 3, "Quadrilaterals": 4, "Tetrahedra": 4, "Hexahedra": 8}
#: Element types by the width of a row of indexes, and the one for other widths.
BY_WIDTH = {2: "Line1NL", 3: "Tri1NL", 6: "Tri2NL", 8: "Hex1NL", 9: "Quad2NL", 10: "Tet2NL", 27: "Hex2NL"}
OTHER_WIDTH = "Tet1NL"


def files(spark: SparkSession, path) -> DataFrame:
    """(file, text) of every file under a path, a pattern or a list of paths."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.text(paths, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))


def tokens(df: DataFrame) -> DataFrame:
    """(file, at, token): white space apart, numbered from 0."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return df.select("file", F.posexplode(words).alias("at", "token"))


def _matrix(df: DataFrame, kind: str, shift: int) -> DataFrame:
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    df = df.select("file", words.alias("w"))
    width = F.get("w", 1).cast("int")
    rows = df.select("file", width.alias("m"), F.posexplode(F.slice("w", F.lit(3), F.size("w"))).alias("at", "token"))
    cells = rows.select("file", F.floor(F.col("at") / F.col("m")).alias("row_id"), (F.col("at") % F.col("m")).alias("k"), (F.col("token").cast(kind) - shift).alias("v"))
    return cells.groupBy("file", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("vals"))


def cheart_values(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, vals) of node files (.X) and field files (.D): a header `n m`, then n × m numbers."""
    return _matrix(files(spark, path), "double", 0)


def cheart_topology(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, node_ids) of topology files (.T): the header's second number is the count of nodes, so the width comes from the first data line; rows may wrap over lines."""
    df = files(spark, path)
    body = F.regexp_replace("text", r"^\s*\d+\s+\d+", "")
    n = F.regexp_extract("text", r"^\s*(\d+)", 1).cast("int")
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    df = df.select("file", n.alias("n"), words.alias("w"))
    rows = df.select("file", (F.size("w") / F.greatest("n", F.lit(1))).cast("int").alias("m"), F.posexplode("w").alias("at", "token"))
    cells = rows.select("file", F.floor(F.col("at") / F.col("m")).alias("row_id"), (F.col("at") % F.col("m")).alias("k"), (F.col("token").cast("bigint") - 1).alias("v"))
    return cells.groupBy("file", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda c: c["v"]).alias("node_ids"))


def element_type(width: Column) -> Column:
    out = F.lit(None)
    for n, name in BY_WIDTH.items():
        out = F.when(width == n, name) if n == 2 else out.when(width == n, name)
    return out.otherwise(OTHER_WIDTH)


def timestep(file: Column) -> Column:
    """The number before the extension of names such as Box0003.X; null without one."""
    return F.regexp_extract(file, r"(\d+)\.[^.]*$", 1).try_cast("int")


def write_cheart(df: DataFrame, path: str, kind: str = "values", shift: int = 0) -> None:
    """(name, row_id, vals) as one text file per name below path/name=…: header and rows in order."""
    width = F.max(F.size("vals"))
    header = df.groupBy("name").agg(F.concat_ws(" ", F.count("*").cast("string"), width.cast("string")).alias("line")).withColumn("row_id", F.lit(-1).cast("bigint"))
    lines = df.select("name", F.array_join(F.transform("vals", lambda v: (v + shift).cast("string")), " ").alias("line"), F.col("row_id").cast("bigint").alias("row_id"))
    out = _by_name(header.select("name", "line", "row_id").unionByName(lines)).sortWithinPartitions("name", "row_id")
    out.select("name", "line").write.partitionBy("name").text(path)


def medit(spark: SparkSession, path) -> DataFrame:
    """(file, section, row_id, vals) of Medit meshes: vertices keep coordinates, elements 0-based nodes; references are dropped."""
    t = tokens(files(spark, path))
    known = F.col("token").isin(*MEDIT, "End")
    w = Window.partitionBy("file").orderBy("at")
    section = F.last(F.when(known, F.col("token")), ignorenulls=True).over(w)
    t = t.withColumn("section", section).where(F.col("section").isin(*MEDIT))
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("file", "section").orderBy("at")) - 3).where("k >= 0")
    width = F.lit(4)
    for name, n in MEDIT.items():
        width = F.when(F.col("section") == name, n + 1 if n else 4).otherwise(width)
    t = t.withColumns({"m": width, "shift": (F.col("section") != "Vertices").cast("int")})
    t = t.select("file", "section", F.floor(F.col("k") / F.col("m")).alias("row_id"), (F.col("k") % F.col("m")).alias("j"), "m", (F.col("token").cast("double") - F.col("shift")).alias("v"))
    rows = t.where("j < m - 1").groupBy("file", "section", "row_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda c: c["v"]).alias("vals"))
    return rows.withColumn("vals", x_fastest(F.col("vals"), F.col("section") == "Quadrilaterals", F.col("section") == "Hexahedra"))


def x_fastest(ids: Column, quad: Column, hex: Column) -> Column:
    """Corners given around a face in the order of the library, x fastest: each second pair of a square changes places."""
    pick = lambda *k: F.array(*(F.get(ids, i) for i in k))
    return F.when(quad, pick(0, 1, 3, 2)).when(hex, pick(0, 1, 3, 2, 4, 5, 7, 6)).otherwise(ids)


def stl(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, normal, corners) of ASCII STL facets; corners are three points of three numbers."""
    number = r"([-+0-9.eE]+)"
    facet = r"facet\s+normal\s+" + r"\s+".join([number] * 3) + r"\s+outer\s+loop\s+" + r"\s+".join(["vertex\\s+" + r"\s+".join([number] * 3)] * 3)
    found = files(spark, path).select("file", F.posexplode(F.regexp_extract_all("text", F.lit("(" + facet + ")"), F.lit(1))).alias("row_id", "facet"))
    values = F.transform(F.regexp_extract_all("facet", F.lit(r"(?<=\s)" + number), F.lit(1)), lambda v: v.cast("double"))
    v = found.select("file", "row_id", values.alias("v"))
    return v.select("file", "row_id", F.slice("v", 1, 3).alias("normal"), F.array(*(F.slice("v", 4 + 3 * k, 3) for k in range(3))).alias("corners"))


def vtk_points(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, vals) of the POINTS of legacy ASCII VTK files."""
    body = F.regexp_extract("text", r"(?is)POINTS\s+\d+\s+\w+\s+([-+0-9.eE\s]+)", 1)
    words = F.filter(F.split(body, r"\s+"), lambda w: w != "")
    cells = files(spark, path).select("file", F.posexplode(words).alias("at", "token"))
    return cells.groupBy("file", F.floor(F.col("at") / 3).alias("row_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("token").cast("double").alias("v")))), lambda c: c["v"]).alias("vals"))


#: Numbers of VTK's cell types by the name of an element, whose corners VTK lists around a face where they are four or eight.
VTK_CELLS = {"Line": 3, "Tri": 5, "Quad": 9, "Tet": 10, "Hex": 12}
#: VTK's cell types that list corners with x fastest.
VTK_PLAIN = {"Quad": 8, "Hex": 11}


def vtk_cells(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, geometry, node_ids) of the CELLS or POLYGONS of legacy ASCII VTK files, a line each; files in a folder name=… go by that name.

    Corners come in the order of the library, x fastest; geometry is null for polygons and for types it has no name for."""
    body = F.regexp_extract("text", r"(?is)(?:CELLS|POLYGONS)\s+\d+\s+\d+\s+([0-9\s]+)", 1)
    lines = F.filter(F.split(body, r"\n"), lambda x: F.trim(x) != "")
    source = _named(spark, path).withColumnRenamed("name", "file")
    rows = source.select("file", F.posexplode(lines).alias("row_id", "line"))
    ids = F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("bigint"))
    cells = rows.select("file", "row_id", F.slice(ids, F.lit(2), F.get(ids, 0).cast("int")).alias("node_ids"))
    types = F.filter(F.split(F.regexp_extract("text", r"(?is)CELL_TYPES\s+\d+\s+([0-9\s]+)", 1), r"\s+"), lambda w: w != "")
    kinds = source.select("file", F.posexplode(types).alias("row_id", "_type"))
    named, plain = F.lit(None), F.lit(False)
    for name, number in VTK_CELLS.items():
        named = F.when(F.col("_type").cast("int") == number, name).otherwise(named)
    for name, number in VTK_PLAIN.items():
        named = F.when(F.col("_type").cast("int") == number, name).otherwise(named)
        plain = plain | F.coalesce(F.col("_type").cast("int") == number, F.lit(False))
    joined = cells.join(kinds, ["file", "row_id"], "left").withColumns({"geometry": named, "_plain": plain})
    around = lambda g: (F.col("geometry") == g) & ~F.col("_plain")
    return joined.select("file", "row_id", "geometry", x_fastest(F.col("node_ids"), around("Quad"), around("Hex")).alias("node_ids"))


def key_values(spark: SparkSession, path, separator: str = "=") -> DataFrame:
    """(file, section, key, value) of INI-like files; comments begin with # or ;."""
    lines = files(spark, path).select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    lines = lines.withColumn("line", F.trim("line")).where((F.col("line") != "") & ~F.col("line").rlike("^[#;]"))
    name = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    section = F.last(F.when(F.col("line").rlike(r"^\[.*\]$"), name), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    lines = lines.withColumn("section", F.coalesce(section, F.lit(""))).where(F.col("line").contains(separator))
    parts = F.split("line", separator, 2)
    return lines.select("file", "section", F.trim(F.get(parts, 0)).alias("key"), F.trim(F.get(parts, 1)).alias("value"))


def par_rows(spark: SparkSession, path) -> DataFrame:
    """(file, row_id, vals) of the image rows of PAR headers: lines that begin with a number."""
    text = spark.read.option("pathGlobFilter", "*.{par,PAR}").text([path] if isinstance(path, str) else list(path), wholetext=True)
    named = text.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.col("value").alias("text"))
    lines = named.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("row_id", "line"))
    rows = lines.where(F.col("line").rlike(r"^\s*\d"))
    return rows.select("file", "row_id", F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.try_cast("double")).alias("vals"))


#: Columns of a PAR image row, from 0.
PAR = {"slice": 0, "dynamic": 2, "phase": 3, "image_type": 4, "bits": 7, "width": 9, "height": 10, "intercept": 11, "slope": 12, "trigger": 32}


def par_pixels(spark: SparkSession, path, rescaled: bool = True) -> DataFrame:
    """(file, image_type, dynamic, phase, slice, ts, row, col, val) of PAR headers and the REC files of the same name beside them.

    Images lie in the REC file in the order of the header's rows. Values are slope × stored + intercept, or as stored. A REC
    file of another size than its header says is an error. One file is read by one task."""
    import numpy as np
    import pandas as pd

    rows = par_rows(spark, path)
    field = {k: F.get("vals", n) for k, n in PAR.items()}
    images = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row_id", *(c.alias(k) for k, c in field.items())))).alias("images"))
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    folder = path if isinstance(path, str) else list(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{rec,REC}").load(folder).select(stem(F.element_at(F.split("path", "/"), -1)).alias("_stem"), "content")
    joined = images.withColumn("_stem", stem("file")).join(found, "_stem").select("file", "images", "content")
    names = "file string, image_type int, dynamic int, phase int, slice int, ts double, row int, col int, val double"

    def read(batches):
        for pdf in batches:
            for file, images, content in zip(pdf.file, pdf.images, pdf.content):
                at, data = 0, bytes(content)
                sizes = [int(i["width"]) * int(i["height"]) * int(i["bits"]) // 8 for i in images]
                if sum(sizes) != len(data):
                    raise ValueError(f"the pixels of {file} have {len(data)} bytes, its header says {sum(sizes)}")
                for i, size in zip(images, sizes):
                    grid = np.frombuffer(data, f"<u{int(i['bits']) // 8}", size * 8 // int(i["bits"]), at).astype(float).reshape(int(i["height"]), int(i["width"]))
                    at += size
                    grid = grid * i["slope"] + i["intercept"] if rescaled else grid
                    row, col = np.indices(grid.shape)
                    told = {"file": file, "image_type": int(i["image_type"]), "dynamic": int(i["dynamic"]), "phase": int(i["phase"]), "slice": int(i["slice"]), "ts": float(i["trigger"])}
                    yield pd.DataFrame(told | {"row": row.ravel(), "col": col.ravel(), "val": grid.ravel()})

    return joined.mapInPandas(read, names)


def _by_name(lines: DataFrame) -> DataFrame:
    """Rows of a name in one task. By a hash of it: Spark takes a union of parts that are dealt by name to be so itself, leaves the exchange out and then joins tasks of each part apart."""
    return lines.repartition(F.xxhash64("name"))


def _write_lines(lines: DataFrame, path: str) -> None:
    """(name, part, row_id, line) as one text file per name below path/name=…, by part and row; a file is one task's."""
    _by_name(lines).sortWithinPartitions("name", "part", "row_id").select("name", "line").write.partitionBy("name").text(path)


def _joined(values: str | Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), " ")


def _heads(df: DataFrame, part: int, line: Column) -> DataFrame:
    return df.groupBy("name").agg(line.alias("line")).select("name", F.lit(part).alias("part"), F.lit(-1).cast("bigint").alias("row_id"), "line")


def _rows(df: DataFrame, part: int, line: Column) -> DataFrame:
    return df.select("name", F.lit(part).alias("part"), F.col("row_id").cast("bigint").alias("row_id"), line.alias("line"))


def write_vtk(nodes: DataFrame, cells: DataFrame, path: str, fields: DataFrame | None = None) -> None:
    """Legacy ASCII VTK files of meshes: nodes (name, row_id, vals), cells (name, row_id, node_ids) and a node field (name, row_id, vals).

    cells may have a column geometry (Line, Tri, Quad, Tet or Hex); without it, it follows from the number of corners, four
    being a tetrahedron. Corners of squares and hexahedra are written around their faces."""
    guess = F.size("node_ids")
    guess = F.when(guess == 2, "Line").when(guess == 3, "Tri").when(guess == 4, "Tet").when(guess == 8, "Hex")
    named = F.coalesce("geometry", guess) if "geometry" in cells.columns else guess
    cells = cells.withColumn("_geometry", named).withColumn("node_ids", x_fastest(F.col("node_ids"), F.col("_geometry") == "Quad", F.col("_geometry") == "Hex"))
    count = F.count("*").cast("string")
    lines = _heads(nodes, 0, F.lit("# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID"))
    lines = lines.unionByName(_heads(nodes, 1, F.concat(F.lit("POINTS "), count, F.lit(" double")))).unionByName(_rows(nodes, 1, _joined("vals")))
    lines = lines.unionByName(_heads(cells, 2, F.concat(F.lit("CELLS "), count, F.lit(" "), (F.count("*") + F.sum(F.size("node_ids"))).cast("string"))))
    lines = lines.unionByName(_rows(cells, 2, F.concat_ws(" ", F.size("node_ids").cast("string"), _joined("node_ids"))))
    kind = F.lit("7")
    for name, number in VTK_CELLS.items():
        kind = F.when(F.col("_geometry") == name, str(number)).otherwise(kind)
    lines = lines.unionByName(_heads(cells, 3, F.concat(F.lit("CELL_TYPES "), count))).unionByName(_rows(cells, 3, kind))
    if fields is not None:
        lines = lines.unionByName(_heads(fields, 4, F.concat(F.lit("POINT_DATA "), count, F.lit("\nSCALARS field double 1\nLOOKUP_TABLE default")))).unionByName(_rows(fields, 4, _joined("vals")))
    _write_lines(lines, path)


def write_vtu(arrays: DataFrame, path: str) -> None:
    """VTK XML files with one ASCII DataArray for each array (name, array, row_id, vals)."""
    names = arrays.groupBy("name", "array").agg(F.max(F.size("vals")).alias("m"))
    key = lambda at, up: F.concat(F.lit(at), F.col("array"), F.lit(up))
    line = lambda df, part, row, text: df.select("name", part.alias("part"), row.cast("bigint").alias("row_id"), text.alias("line"))
    out = line(arrays.select("name").distinct(), F.lit("0"), F.lit(0), F.lit('<VTKFile type="UnstructuredGrid"><UnstructuredGrid><Piece>'))
    out = out.unionByName(line(names, key("1", "a"), F.lit(0), F.concat(F.lit('<DataArray Name="'), F.col("array"), F.lit('" format="ascii" NumberOfComponents="'), F.col("m").cast("string"), F.lit('">'))))
    out = out.unionByName(line(arrays, key("1", "b"), F.col("row_id"), _joined("vals"))).unionByName(line(names, key("1", "c"), F.lit(0), F.lit("</DataArray>")))
    _write_lines(out.unionByName(line(arrays.select("name").distinct(), F.lit("2"), F.lit(0), F.lit("</Piece></UnstructuredGrid></VTKFile>"))), path)


def vtu_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(name, array, row_id, vals) of the ASCII DataArrays of VTK XML files; the name is that of the folder or the file."""
    df = _named(spark, path)
    tags = F.expr(r"regexp_extract_all(text, '(?s)(<DataArray[^>]*>[^<]*)</DataArray>', 1)")
    parts = df.select("name", F.explode(tags).alias("a"))
    attribute = lambda k: F.regexp_extract("a", k + '="([^"]*)"', 1)
    width = F.coalesce(attribute("NumberOfComponents").try_cast("int"), F.lit(1))
    words = F.filter(F.split(F.regexp_extract("a", "(?s)>(.*)$", 1), r"\s+"), lambda w: w != "")
    # Each word is a row of its own before rows are put together: an array that goes along with each of its rows would grow with their square.
    cells = parts.select("name", attribute("Name").alias("array"), width.alias("m"), words.alias("w")).select("name", "array", "m", F.posexplode("w").alias("at", "token"))
    cells = cells.select("name", "array", F.floor(F.col("at") / F.col("m")).alias("row_id"), "m", (F.col("at") % F.col("m")).alias("k"), F.col("token").cast("double").alias("v"))
    rows = cells.groupBy("name", "array", "row_id", "m").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("c"))
    return rows.where(F.size("c") == F.col("m")).select("name", "array", "row_id", F.transform("c", lambda c: c["v"]).alias("vals"))


def _named(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): whole files, named by the folder name=… that they lie in, else by themselves."""
    df = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.col("value").alias("text"))
    folder = F.regexp_extract("p", "/name=([^/]*)/", 1)
    return df.select(F.when(folder != "", folder).otherwise(F.element_at(F.split("p", "/"), -1)).alias("name"), "text")


def vtk_arrays(spark: SparkSession, path: str, section: str, skip: int = 0) -> DataFrame:
    """(name, row_id, vals) of the lines of a section of legacy ASCII VTK files, without the first `skip` ones."""
    body = F.regexp_extract("text", rf"(?s)(?:^|\n){section}[^\n]*\n([-+0-9eE.\s]*)", 1)
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    rows = _named(spark, path).select("name", F.posexplode(F.slice(lines, skip + 1, 1 << 30)).alias("row_id", "line"))
    return rows.select("name", F.col("row_id").cast("bigint").alias("row_id"), F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("vals"))


def sequence(frames: DataFrame) -> DataFrame:
    """(step, ...): rows of a time-dependent mesh, steps by the number in the file's name, else by its order."""
    names = frames.select("name").distinct()
    number = F.regexp_extract("name", r"(\d+)[^\d]*$", 1).try_cast("bigint")
    return frames.join(names.select("name", number.alias("step")), "name")


def write_matrix(df: DataFrame, path: str, kind: str, meta: dict[str, str] | None = None) -> None:
    """Text matrices (name, row_id, vals): name, kind and type, `n m`, lines `key = value`, then rows."""
    top = F.concat(F.col("name"), F.lit(f"\n{kind} double\n"))
    notes = "".join(f"\n{k} = {v}" for k, v in sorted((meta or {}).items()))
    head = df.groupBy("name").agg(F.concat(F.count("*").cast("string"), F.lit(" "), F.max(F.size("vals")).cast("string")).alias("n"))
    head = head.select("name", F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("row_id"), F.concat(top, "n", F.lit(notes)).alias("line"))
    _write_lines(head.unionByName(_rows(df, 1, _joined("vals"))), path)


def matrices(spark: SparkSession, path: str) -> DataFrame:
    """(name, meta, row_id, vals) of text matrices; files are only read."""
    lines = F.split("text", r"\r?\n")
    df = _named(spark, path).select(F.get(lines, 0).alias("name"), F.slice(lines, 4, 1 << 30).alias("rest"))
    note = lambda x: F.contains(x, F.lit(" = "))
    meta = F.map_from_entries(F.transform(F.filter("rest", note), lambda x: F.struct(F.get(F.split(x, " = "), 0), F.get(F.split(x, " = "), 1))))
    # The notes are read before lines become rows, else once for each of them.
    df = df.select("name", meta.alias("meta"), F.filter("rest", lambda x: ~note(x) & (F.trim(x) != "")).alias("lines"))
    rows = df.select("name", "meta", F.posexplode("lines").alias("row_id", "line"))
    return rows.select("name", "meta", F.col("row_id").cast("bigint").alias("row_id"), F.transform(F.split(F.trim("line"), r"\s+"), lambda v: v.cast("double")).alias("vals"))


def write_key_values(df: DataFrame, path: str) -> None:
    """INI-like stores (name, section, key, value), as plots, measurements and contours are kept."""
    heads = df.select("name", "section").distinct().select("name", F.col("section").alias("part"), F.lit(0).cast("bigint").alias("row_id"), F.concat(F.lit("["), "section", F.lit("]")).alias("line"))
    rows = df.select("name", F.col("section").alias("part"), F.lit(1).cast("bigint").alias("row_id"), F.concat_ws(" = ", "key", "value").alias("line"))
    _write_lines(heads.unionByName(rows), path)


def literal(text: Column, kind: str) -> Column:
    """A Python literal of numbers, lists and tuples as a value of a Spark type such as array<array<double>>."""
    return F.from_json(F.translate(text, "()", "[]"), kind)


def literal_text(value: Column) -> Column:
    """A number or nested array as such a literal."""
    return F.to_json(value)


def stores(spark: SparkSession, path: str) -> DataFrame:
    """(name, section, key, value) of INI-like stores, named by their folder name=… or file."""
    lines = F.transform(F.split("text", r"\r?\n"), F.trim)
    parts = F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), r"\n\[")
    sections = _named(spark, path).select("name", F.explode(F.slice(parts, 2, 1 << 30)).alias("s"))
    rows = sections.select("name", F.regexp_extract("s", r"^([^\]]*)\]", 1).alias("section"), F.explode(F.split(F.regexp_extract("s", r"(?s)^[^\]]*\](.*)$", 1), "\n")).alias("line"))
    rows = rows.where(F.contains("line", F.lit("=")) & ~F.rlike("line", F.lit("^[#;]")))
    return rows.select("name", "section", F.trim(F.regexp_extract("line", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("line", "=(.*)$", 1)).alias("value"))
