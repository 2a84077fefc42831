"""Formats: tables written with the library's writers and read back with its readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.stored import shared_path, stored
from ..sources import binary_images, binary_sinks, dicom, encoded_xml, text_meshes
from .image_queries import PIXELS, pixels
from .registry import query, table

GRID = PIXELS + ", g AS (SELECT i.image_id, y, x, round(coalesce(val, 0), 0) AS val FROM (SELECT DISTINCT image_id FROM p) i, range(0, 24) a(y), range(0, 16) b(x) LEFT JOIN p ON p.image_id = i.image_id AND row = y AND col = x) "


def image_files(spark, d):
    """Each image of the event pixels as one file of 16 × 24 whole values."""
    p = pixels(spark, d).select("image_id", (F.col("row") * 16 + F.col("col")).alias("at"), F.round("val", 0).alias("val"))
    return binary_sinks.volumes_of(p, "image_id", (16, 24, 1), (1.5, 2.0, 3.0), (10.0, -20.0, 5.0))


def _image_round_trip(spark, d, kind, ending, **settings):
    path = shared_path(spark, "images")
    files = binary_sinks.encoded(image_files(spark, d), kind, **settings).withColumn("file", F.concat("file", F.lit(ending)))
    binary_sinks.write_binary(files, path)
    read = binary_images.volumes(spark, path, kind)
    places = read.select("file", F.get("origin", 0).alias("origin_x"), F.get("spacing", 1).alias("spacing_y"))
    found = binary_images.pixels(read).join(places, "file")
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "x", "y", "val", "origin_x", "spacing_y")


_ROUND_TRIP = GRID + "SELECT image_id::BIGINT AS image_id, x::INT AS x, y::INT AS y, val::DOUBLE AS val, 10.0::DOUBLE AS origin_x, 2.0::DOUBLE AS spacing_y FROM g"


@query("nifti_files", _ROUND_TRIP)
def _(spark, d):
    return _image_round_trip(spark, d, "nifti", ".nii")


@query("metaimage_files", _ROUND_TRIP)
def _(spark, d):
    return _image_round_trip(spark, d, "metaimage", ".mha", dtype="i4")


@query("image_slices", GRID + "SELECT image_id::BIGINT AS image_id, y::INT AS row, x::INT AS col, least(255, greatest(0, val))::DOUBLE AS val FROM g")
def _(spark, d):
    path = shared_path(spark, "slices")
    binary_sinks.write_binary(binary_sinks.encoded(image_files(spark, d), "png").withColumn("file", F.concat("file", F.lit("_0001_0000.png"))), path)
    found = binary_sinks.image_slices(spark, path)
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "row", "col", "val")


def _planes(spark, d):
    """The same images as DICOM planes of two series, with the values over 20 as overlay."""
    k = F.col("file").cast("int")
    return image_files(spark, d).select(
        F.concat("file", F.lit(".dcm")).alias("file"), F.concat(F.lit("1.2.3."), (k % 2).cast("string")).alias("series_uid"), (k % 2).cast("double").alias("series_number"), F.concat(F.lit("series "), (k % 2).cast("string")).alias("description"), k.cast("double").alias("instance"), (k * 10.0).alias("time"),
        F.array(F.lit(1.0), F.lit(2.0), k.cast("double")).alias("position"), F.lit([1.0, 0.0, 0.0, 0.0, 1.0, 0.0]).alias("orientation"), F.lit([2.0, 1.5]).alias("spacing"), F.lit(2.0).alias("slope"), F.lit(-5.0).alias("intercept"), F.lit(24).alias("rows"), F.lit(16).alias("cols"),
        "vals", F.transform("vals", lambda v: (v > 20).cast("int")).alias("overlay"),
    )


def dicom_files(spark, d):
    path = shared_path(spark, "dicom")
    binary_sinks.write_binary(dicom.planes(_planes(spark, d)), path)
    return path


@query("dicom_series", "SELECT '1.2.3.' || image_id % 2 AS series_uid, (image_id % 2)::DOUBLE AS series_number, 'series ' || image_id % 2 AS description, count(*) AS n, list(image_id || '.dcm' ORDER BY image_id) AS files FROM (SELECT DISTINCT user_id % 4 AS image_id FROM events) GROUP BY ALL")
def _(spark, d):
    return dicom.series(dicom.headers(spark, dicom_files(spark, d)))


@query("dicom_pixels", GRID + "SELECT image_id::BIGINT AS image_id, y::INT AS row, x::INT AS col, (val * 2 - 5)::DOUBLE AS val, (val > 20)::DOUBLE AS overlay FROM g WHERE y BETWEEN 2 AND 19 AND x < 10")
def _(spark, d):
    path = dicom_files(spark, d)
    crop = (2, 20, 0, 10)
    bits = dicom.pixels(spark, path, crop, overlay=True).withColumnRenamed("val", "overlay")
    found = dicom.pixels(spark, path, crop).join(bits, ["file", "row", "col"])
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "row", "col", "val", "overlay")


def brand_matrices(spark, d):
    """Parts by brand as matrices of size and price."""
    from ..operators.stored import numbered

    ranked = numbered(table(spark, d, "part"), ["p_brand"], ["p_partkey"])
    return ranked.select(F.regexp_replace("p_brand", "#", "_").alias("name"), "row_id", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("vals"))


_BRANDS = "SELECT replace(p_brand, '#', '_') AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS row_id, [p_size::DOUBLE, p_retailprice] AS vals FROM part"


@query("text_matrices", f"SELECT *, 'mm' AS unit FROM ({_BRANDS})")
def _(spark, d):
    path = shared_path(spark, "matrices")
    text_meshes.write_matrix(brand_matrices(spark, d), path, "matrix", {"unit": "mm", "source": "parts"})
    return text_meshes.matrices(spark, path).select("name", "row_id", "vals", F.col("meta")["unit"].alias("unit"))


@query("vtk_files", f"WITH b AS ({_BRANDS}) SELECT name, row_id, list_concat(vals, [0.0]) AS p, [row_id, (row_id + 1) % n, (row_id + 2) % n] AS node_ids, vals[2] AS field FROM b JOIN (SELECT name, count(*) AS n FROM b GROUP BY 1) USING (name)")
def _(spark, d):
    path = shared_path(spark, "vtk")
    rows = brand_matrices(spark, d)
    n = rows.groupBy("name").agg(F.count("*").alias("n"))
    cells = rows.join(n, "name").select("name", "row_id", F.array(*((F.col("row_id") + k) % F.col("n") for k in range(3))).alias("node_ids"))
    text_meshes.write_vtk(rows.withColumn("vals", F.concat("vals", F.array(F.lit(0.0)))), cells, path, rows.withColumn("vals", F.slice("vals", 2, 1)))
    points = text_meshes.vtk_arrays(spark, path, "POINTS").withColumnRenamed("vals", "p")
    ids = text_meshes.vtk_arrays(spark, path, "CELLS").select("name", "row_id", F.transform(F.slice("vals", 2, 3), lambda v: v.cast("bigint")).alias("node_ids"))
    field = text_meshes.vtk_arrays(spark, path, "LOOKUP_TABLE").select("name", "row_id", F.get("vals", 0).alias("field"))
    return points.join(ids, ["name", "row_id"]).join(field, ["name", "row_id"])


@query("vtk_xml_files", f"SELECT name, CASE k WHEN 0 THEN 'points' ELSE 'size' END AS \"array\", row_id, CASE k WHEN 0 THEN vals ELSE vals[1:1] END AS vals FROM ({_BRANDS}), range(0, 2) t(k)")
def _(spark, d):
    path = shared_path(spark, "vtu")
    rows = brand_matrices(spark, d)
    both = rows.withColumn("array", F.lit("points")).unionByName(rows.withColumns({"vals": F.slice("vals", 1, 1), "array": F.lit("size")}))
    text_meshes.write_vtu(both, path)
    return text_meshes.vtu_arrays(spark, path)


@query("mesh_sequence", f"WITH b AS ({_BRANDS}) SELECT regexp_extract(name, '([0-9]+)$', 1)::BIGINT AS step, name, row_id, vals FROM b")
def _(spark, d):
    path = shared_path(spark, "sequence")
    text_meshes.write_vtu(brand_matrices(spark, d).withColumn("array", F.lit("points")), path)
    return text_meshes.sequence(text_meshes.vtu_arrays(spark, path)).select("step", "name", "row_id", "vals")


@query("measure_files", "SELECT user_id::VARCHAR AS name, list(event_id::DOUBLE ORDER BY event_id) AS timesteps, list([round(value, 3), hour(ts)::DOUBLE] ORDER BY event_id) AS vals FROM events GROUP BY 1")
def _(spark, d):
    """Measurements: a section with time steps and points, kept as literals."""
    path = shared_path(spark, "measures")
    e = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("name")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 3).alias("v"), F.hour("ts").cast("double").alias("h")))).alias("e"))
    steps = e.select("name", F.lit("timesteps").alias("key"), text_meshes.literal_text(F.transform("e", lambda x: x["event_id"].cast("double"))).alias("value"))
    points = e.select("name", F.lit("values").alias("key"), text_meshes.literal_text(F.transform("e", lambda x: F.array(x["v"], x["h"]))).alias("value"))
    text_meshes.write_key_values(steps.unionByName(points).withColumn("section", F.lit("measure")), path)
    # A store has two keys: gathering them in each of the many small tasks that read costs more than to send both.
    read = text_meshes.stores(spark, path).repartition("name").groupBy("name").pivot("key", ["timesteps", "values"]).agg(F.first("value"))
    return read.select("name", text_meshes.literal(F.col("timesteps"), "array<double>").alias("timesteps"), text_meshes.literal(F.col("values"), "array<array<double>>").alias("vals"))


@query("nifti_rewrite", GRID + "SELECT image_id::BIGINT AS image_id, x::INT AS x, y::INT AS y, (val * 2 + 1)::DOUBLE AS val FROM g")
def _(spark, d):
    path, out = shared_path(spark, "images"), shared_path(spark, "images")
    binary_sinks.write_binary(binary_sinks.encoded(image_files(spark, d), "nifti").withColumn("file", F.concat("file", F.lit(".nii"))), path)
    binary_sinks.rewrite(spark, path, "nifti", out, lambda v: v.withColumn("vals", F.transform("vals", lambda x: x * 2 + 1)))
    found = binary_images.pixels(binary_images.volumes(spark, out, "nifti"))
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "x", "y", "val")


def turned_files(spark, d):
    """The image files, each turned about another axis by an angle of its number, with a time."""
    k = F.col("file").cast("int")
    c, s = F.cos(k * 0.3), F.sin(k * 0.3)
    one, zero = F.lit(1.0), F.lit(0.0)
    about_z, about_x = F.array(c, -s, zero, s, c, zero, zero, zero, one), F.array(one, zero, zero, zero, c, -s, zero, s, c)
    mirrored = F.array(c, -s, zero, s, c, zero, zero, zero, -one)
    direction = F.when(k % 3 == 0, about_z).when(k % 3 == 1, about_x).otherwise(mirrored)
    return image_files(spark, d).withColumns({"direction": direction, "start": k * 2.5, "interval": F.lit(40.0)})


def _turned_round_trip(spark, d, kind, ending, **settings):
    path = shared_path(spark, "images")
    binary_sinks.write_binary(binary_sinks.encoded(turned_files(spark, d), kind, **settings).withColumn("file", F.concat("file", F.lit(ending))), path)
    found = binary_images.placed_pixels(binary_images.volumes(spark, path, kind))
    return found.select(F.regexp_extract("file", r"^(\d+)", 1).cast("bigint").alias("image_id"), "x", "y", "val", *(F.round(f"p.{c}", 2).alias(f"at_{c}") for c in "xyz"))


_TURNED = GRID + """SELECT image_id::BIGINT AS image_id, x::INT AS x, y::INT AS y, val::DOUBLE AS val,
round(10 + CASE image_id % 3 WHEN 1 THEN 1.5 * x ELSE cos(image_id * 0.3) * 1.5 * x - sin(image_id * 0.3) * 2 * y END, 2) AS at_x, round(-20 + CASE image_id % 3 WHEN 1 THEN cos(image_id * 0.3) * 2 * y ELSE sin(image_id * 0.3) * 1.5 * x + cos(image_id * 0.3) * 2 * y END, 2) AS at_y,
round(5 + CASE image_id % 3 WHEN 1 THEN sin(image_id * 0.3) * 2 * y ELSE 0 END, 2) AS at_z FROM g"""


@query("nifti_oriented", _TURNED)
def _(spark, d):
    """Places of voxels by the quaternion of a NIfTI file, also of a mirrored one."""
    return _turned_round_trip(spark, d, "nifti", ".nii")


@query("metaimage_oriented", _TURNED)
def _(spark, d):
    return _turned_round_trip(spark, d, "metaimage", ".mha", dtype="i4")


@query("dicom_index", "WITH i AS (SELECT DISTINCT (user_id % 4)::INT AS k FROM events) SELECT k || '.dcm' AS file, 0::INT AS scan, '1.2.3.' || k % 2 AS series_uid, NULL AS error FROM i WHERE k <> 0 UNION ALL SELECT 'late_' || k || '.dcm', 1, '1.2.3.' || k % 2, NULL FROM i UNION ALL SELECT '0.dcm', 1, NULL, 'ValueError'")
def _(spark, d):
    """An index brought up to date: new files and one that was damaged are read by the second scan, the others are not."""
    path = dicom_files(spark, d)
    first = stored(dicom.scan(spark, path))
    late = dicom.planes(_planes(spark, d)).withColumn("file", F.concat(F.lit("late_"), "file"))
    cut = late.where("file = 'late_0.dcm'").select(F.lit("0.dcm").alias("file"), F.substring("content", 1, 700).alias("content"))
    binary_sinks.write_binary(late.unionByName(cut), path, overwrite=True)
    found = stored(dicom.scan(spark, path, first))
    return found.select("file", "scan", "series_uid", F.regexp_extract("error", "^(\\w+)", 1).alias("error"))


@query("dicom_time_series", "WITH i AS (SELECT DISTINCT (user_id % 4)::INT AS k FROM events), s AS (SELECT DISTINCT (user_id % 4)::INT AS k, unnest([0, 1, 2]) AS j FROM events) SELECT '1.2.3.' || k % 2 AS series_uid, k || '_' || j || '.dcm' AS file, (dense_rank() OVER (PARTITION BY k % 2 ORDER BY k) - 1)::INT AS slice, j::INT AS step, j * 40.0 + k AS ts FROM s")
def _(spark, d):
    """Planes of two series at several times: slices by their place, steps by their time, seconds as milliseconds."""
    path = shared_path(spark, "dicom")
    k, j = F.element_at(F.split("file", "[_.]"), 1).cast("int"), F.col("j")
    planes = _planes(spark, d).withColumn("j", F.explode(F.lit([0, 1, 2]))).withColumns({"file": F.concat(F.regexp_extract("file", r"^(\d+)", 1), F.lit("_"), F.col("j").cast("string"), F.lit(".dcm"))})
    planes = planes.withColumns({"time": j * 0.04 + k / 1000, "instance": (j * 100 + k).cast("double")}).drop("j")
    binary_sinks.write_binary(dicom.planes(planes, {(0x0010, 0x0020): (b"LO", b"case 7")}), path)
    return dicom.series_images(dicom.headers(spark, path)).withColumn("ts", F.round("ts", 6))


_CUBES = "WITH o AS (SELECT o_orderkey AS k, o_custkey % 5 AS part, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY o_orderkey) - 1 AS r FROM orders) "


@query("vtk_solid_cells", _CUBES + "SELECT 'cells_' || part AS name, r AS row_id, CASE k % 3 WHEN 0 THEN 'Hex' WHEN 1 THEN 'Quad' ELSE 'Tet' END AS geometry, list_transform(range(0, CASE k % 3 WHEN 0 THEN 8 ELSE 4 END), lambda i: k + i) AS node_ids FROM o")
def _(spark, d):
    """Orders as squares, tetrahedra and hexahedra: type and order of corners survive the file."""
    from ..operators.stored import numbered

    path = shared_path(spark, "vtk")
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(k.alias("k"), F.concat(F.lit("cells_"), (F.col("o_custkey") % 5).cast("string")).alias("name"))
    cells = numbered(cells, ["name"], ["k"])
    kind = F.when(F.col("k") % 3 == 0, "Hex").when(F.col("k") % 3 == 1, "Quad").otherwise("Tet")
    cells = cells.select("name", "row_id", kind.alias("geometry"), F.transform(F.sequence(F.lit(0), F.when(F.col("k") % 3 == 0, 7).otherwise(3)), lambda i: F.col("k") + i).alias("node_ids"))
    nodes = cells.select("name", "row_id", F.array(F.col("row_id").cast("double"), F.lit(0.0), F.lit(1.0)).alias("vals"))
    text_meshes.write_vtk(nodes, cells, path)
    return text_meshes.vtk_cells(spark, path).withColumnRenamed("file", "name").withColumn("row_id", F.col("row_id").cast("bigint"))


@query("x4df_files", f"WITH b AS ({_BRANDS}), n AS (SELECT name, count(*) AS n FROM b GROUP BY 1) SELECT name AS mesh, 'nodes' AS kind, 'nodes' AS name, s::INT AS number, s * 0.5::DOUBLE AS ts, row_id, list_transform(vals, lambda v: v + s) AS vals FROM b, range(0, 2) t(s) UNION ALL SELECT name, 'topology', 'tris', 0, NULL, row_id, [row_id, (row_id + 1) % n, (row_id + 2) % n]::DOUBLE[] FROM b JOIN n USING (name) UNION ALL SELECT name, 'field', 'price', s, s * 0.5, row_id, [vals[2] * (s + 1)] FROM b, range(0, 2) t(s)")
def _(spark, d):
    """Meshes with two time steps of nodes and of a field in X4DF files, compressed and as base64."""
    path = shared_path(spark, "x4df")
    rows = brand_matrices(spark, d)
    n = rows.groupBy("name").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    steps = rows.withColumn("s", F.explode(F.lit([0, 1])))
    part = lambda df, kind, name, number, ts, topology, vals: df.select(F.col("name").alias("mesh"), F.lit(kind).alias("kind"), F.lit(name).alias("name"), number.alias("number"), ts.alias("ts"), topology.alias("topology"), F.lit("Tri1NL").alias("elem_type"), F.lit(False).alias("per_element"), "row_id", vals.alias("vals"))
    nodes = part(steps, "nodes", "nodes", F.col("s"), F.col("s") * 0.5, none("string"), F.transform("vals", lambda v: v + F.col("s")))
    tris = part(rows.join(n, "name"), "topology", "tris", F.lit(0), none("double"), none("string"), F.array(*(((F.col("row_id") + k) % F.col("n")).cast("double") for k in range(3))))
    price = part(steps, "field", "price", F.col("s"), F.col("s") * 0.5, F.lit("tris"), F.array(F.get("vals", 1) * (F.col("s") + 1)))
    encoded_xml.write_x4df(nodes.unionByName(tris).unionByName(price), path)
    return encoded_xml.x4df(spark, path).select("mesh", "kind", "name", "number", "ts", "row_id", "vals")
