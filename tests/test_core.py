import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import basis, strings, vec
from meshlake.operators import matrix, mesh, spatial, volumes
from meshlake.operators.stored import numbered
from meshlake.sources import binary_images, binary_sinks, dicom, load, text_meshes


def test_dense_ids_with_payload_over_many_tasks(spark):
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.col("id").alias("payload"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("skewed"))
    for n, order in ((2_000_000, ["skewed", "payload"]), (100_000, ["k", "payload"])):
        ids = matrix.dense_ids(df.where(F.col("payload") < n), order, "row_id", rows_per_task=n // 20)
        assert ids.agg(F.count("*"), F.count_distinct("row_id"), F.min("row_id"), F.max("row_id")).first()[:] == (n, n, 0, n - 1)
        w = ids.select("row_id", F.struct(*order).alias("o"))
        if n > 100_000:
            continue
        assert w.join(w.select((F.col("row_id") - 1).alias("row_id"), F.col("o").alias("n")), "row_id").where("o > n").count() == 0


def test_reindex_numbers_ties_by_node(spark):
    """Many elements have the same number, so many nodes the same first use."""
    df = spark.range(3000).select((F.col("id") % 7).alias("elem_id"), F.array(F.col("id") * 1237 % 3001).alias("node_ids")).repartition(5)
    used = sorted((k % 7, k * 1237 % 3001) for k in range(3000))
    # Small partitions would be merged to one, in which nodes are in order by themselves.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert [r.node_id for r in spatial.reindex(df).orderBy("new_id").collect()] == [node for _, node in used]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbered_within_hot_and_null_keys(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, (F.col("id") % 50).cast("string")).alias("k"), "id")
    got = numbered(df, ["k"], ["id"], "n", rows_per_task=1000)
    want = got.groupBy("k").agg(F.count("*").alias("c"), F.count_distinct("n").alias("d"), F.max("n").alias("m")).collect()
    assert sum(r.c for r in want) == 30_000 and all(r.c == r.d == r.m + 1 for r in want)


def test_unique_names_are_unique(spark):
    names = ["a"] * 130 + ["a_01", "a_03", "a_01", "b", "b_2", "c_001"]
    df = spark.createDataFrame(list(enumerate(names)), "k int, name string")
    got = [r.unique_name for r in strings.unique_names(df, "name", "k").orderBy("k").collect()]
    assert len(set(got)) == len(names) and got[:4] == ["a", "a_02", "a_04", "a_05"] and "a_100" in got and "a_01_01" in got


def test_data_size_rounds_halves_to_even(spark):
    sizes = [1000, 1001, 1157, 1167, 1029, 5 * 1024**5]
    got = [r.s for r in spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "k int, n bigint").orderBy("k").select(strings.data_size(F.col("n")).alias("s")).collect()]
    assert got == ["1000.00B", *(f"{n / 1024:.2f}kB" for n in sizes[1:5]), "5.00PB"]


def test_elements_with_missing_nodes_have_no_value(spark):
    elements = spark.createDataFrame([(1, [0, 1, 2]), (2, [0, 1, 9])], "elem_id int, node_ids array<bigint>")
    values = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "node_id bigint, val double")
    got = {r.elem_id: r.val for r in mesh.evaluate(elements, values, "Tri1NL", (0.25, 0.25)).collect()}
    assert got == {1: 2.0, 2: None}


def test_places_go_to_their_elements_as_numbers(spark):
    """Places twice, without an element or a place, and short ones; elements twice, short, long and with missing nodes; a node with two values."""
    elements = [(1, [0, 1, 2]), (2, [0, 1, 9]), (3, [0, None, 2]), (4, [0, 1]), (5, [0, 1, 2, 1]), (6, []), (7, None), (8, [0, 1, 2]), (8, [2, 1, 0]), (9, [0, 1, 3]), (None, [0, 1, 2]), (10, [2, 1, 0])]
    values = [(0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0), (3, 9.0), (4, None), (None, 5.0)]
    places = [(e, 0, [0.25, 0.5]) for e in (*range(1, 12), None)] + [(1, 1, [0.0, 0.0]), (1, 1, [0.0, 0.0]), (1, 2, None), (1, 3, [0.5]), (1, 4, [0.5, None]), (1, 5, [0.5, 0.5, 7.0]), (1, None, [1.0, 0.0])]
    tables = spark.createDataFrame(places, "elem_id int, point_id int, xi array<double>"), spark.createDataFrame(elements, "elem_id int, node_ids array<bigint>"), spark.createDataFrame(values, "node_id bigint, val double")
    found = mesh.evaluate_at(*tables, "Tri1NL")
    got = sorted(((r.elem_id, r.point_id, r.val) for r in found.collect()), key=repr)
    want = [(1, 0, 2.75), (10, 0, 2.0), (1, 1, 1.0), (1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, None), (1, 5, 3.0), (1, None, 2.0)] + [(e, 0, None) for e in (2, 3, 4, 5, 8, 9)]
    assert got == sorted(want, key=repr) and found.columns == ["elem_id", "point_id", "val"]
    # Below the join of places and elements: no array is sent, and nodes are dealt before they are gathered.
    plan = found._jdf.queryExecution().optimizedPlan()
    sides = [plan.child().left(), plan.child().right()] if "Join" not in plan.nodeName() else [plan.left(), plan.right()]
    assert "array" not in sides[0].schema().simpleString()
    steps = [line for line in sides[1].toString().splitlines() if "Aggregate" in line or "Repartition" in line]
    assert "Aggregate" in steps[0] and "Repartition" in steps[1]


def test_corners_x_fastest(spark, tmp_path):
    (tmp_path / "a.mesh").write_text("MeshVersionFormatted 1\nDimension 3\nVertices 8\n" + "0 0 0 0\n" * 8 + "Quadrilaterals 1\n1 2 3 4 0\nHexahedra 1\n1 2 3 4 5 6 7 8 0\nEnd\n")
    got = {r.section: r.vals for r in text_meshes.medit(spark, str(tmp_path / "a.mesh")).where("section <> 'Vertices'").collect()}
    assert got == {"Quadrilaterals": [0, 1, 3, 2], "Hexahedra": [0, 1, 3, 2, 4, 5, 7, 6]}


def test_bases_are_partitions_and_interpolate(spark):
    t = [0.0, 0.21, 0.5, 0.83, 1.0]
    df = spark.createDataFrame([(v,) for v in t], "t double")
    for weights in (basis.spectral_line(F.col("t"), 4), basis.piecewise_catmull_rom(F.col("t"), 5), basis.piecewise_catmull_rom(F.col("t"), 5, circular=True), basis.b_spline(F.col("t"), [0, 0, 0, 0.5, 1, 1, 1], 2), basis.rational([1, 3, 2, 1], basis.b_spline(F.col("t"), [0, 0, 0, 0.5, 1, 1, 1], 2))):
        assert all(abs(sum(r) - 1) < 1e-9 for r in df.select(*weights).collect())
    points = basis.lobatto_points(4)
    rows = spark.createDataFrame([(float(p),) for p in points], "t double").select(*basis.spectral_line(F.col("t"), 4)).collect()
    assert np.allclose(np.array(rows), np.eye(5), atol=1e-9)
    modal = df.select(*basis.modal_line(F.col("t"), 5)).collect()
    assert np.allclose(modal[0], [1, 0, 0, 0, 0, 0]) and np.allclose(modal[-1], [0, 1, 0, 0, 0, 0])


def test_locate_finds_the_same_as_all_pairs(spark):
    rng = np.random.default_rng(3)
    tets, points = rng.uniform(-1, 1, (60, 4, 3)), rng.uniform(-1, 1, (80, 3))
    p = lambda v: tuple(map(float, v))
    xyz = "struct<x:double,y:double,z:double>"
    df = spark.createDataFrame([(k, *(p(c) for c in t)) for k, t in enumerate(tets)], f"elem_id int, a {xyz}, b {xyz}, c {xyz}, d {xyz}")
    asked = spark.createDataFrame([(k, p(v)) for k, v in enumerate(points)], f"id int, p {xyz}")
    got = {(r.id, r.elem_id) for r in spatial.locate(asked, df, 0.3).collect()}
    want = set()
    for k, t in enumerate(tets):
        xi = np.linalg.solve((t[1:] - t[0]).T, (points - t[0]).T)
        want |= {(int(i), k) for i in np.flatnonzero((xi >= 0).all(0) & (xi.sum(0) <= 1))}
    assert got == want and len(want) > 50


def test_rotation_matrix_equals_quaternion_product(spark):
    q, v = np.array([0.1, -0.4, 0.2, 0.88]), np.array([1.0, 2.0, -3.0])
    q /= np.linalg.norm(q)
    got = spark.range(1).select(vec.rotate(vec.quaternion(*q), vec.vec(*v)).alias("r")).first().r
    assert np.allclose(list(got), v + 2 * np.cross(q[:3], np.cross(q[:3], v) + q[3] * v))


def test_objects_and_holes(spark):
    rows = ["111101", "100101", "100111", "111100", "000001", "110001"]
    mask = spark.createDataFrame([(1, r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x == "1"], "image int, row int, col int")
    found = volumes.objects(mask, ["image"])
    assert sorted(r.n for r in found.groupBy("object").agg(F.count("*").alias("n")).collect()) == [2, 2, 16]
    assert volumes.objects(mask, ["image"], diagonal=True).select("object").distinct().count() == 3
    assert volumes.largest_object(mask, ["image"]).count() == 16
    assert sorted((r.row, r.col) for r in volumes.holes(mask, ["image"], 6, 6).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_contour_of_a_square(spark):
    square = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 4.0), (3, 0.0, 4.0)]
    df = spark.createDataFrame(square, "at int, x double, y double").select(F.lit(1).alias("k"), "at", vec.vec(F.col("x"), F.col("y"), 2.0).alias("p"))
    plane = volumes.contour_planes(df, ["k"]).first()
    assert plane.area == 16 and plane.length == 16 and list(plane.normal) == [0, 0, 1] and list(plane.center) == [2, 2, 2]
    got = [(round(r.p.x, 6), round(r.p.y, 6)) for r in volumes.resample_contour(df, ["k"], 8).orderBy("k", "p.x").collect()]
    assert sorted(got) == sorted([(0, 0), (2, 0), (4, 0), (4, 2), (4, 4), (2, 4), (0, 4), (0, 2)])


def test_sinks_refuse_to_overwrite_and_readers_by_name(spark, tmp_path):
    volume = spark.createDataFrame([("a.nii", [2, 3, 1], [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [float(k) for k in range(6)], binary_images.UPRIGHT, 0.0, 1.0)], binary_images.VOLUME)
    folder = str(tmp_path / "out")
    binary_sinks.write_binary(binary_sinks.encoded(volume, "nifti"), folder)
    with pytest.raises(FileExistsError):
        binary_sinks.write_binary(binary_sinks.encoded(volume, "nifti"), folder)
    back = load.load(spark, f"{folder}/a.nii").first()
    assert (back.shape, back.spacing, back.origin, back.vals) == ([2, 3, 1], [1.0, 2.0, 3.0], [4.0, 5.0, 6.0], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])
    with pytest.raises(ValueError):
        load.load(spark, "a.unknown")


def test_dicom_zip_implicit_and_foreign_files(spark, tmp_path):
    head = dict(series_uid="1.2", series_number=3, description="d", instance=1, time=0.0, position=[0, 0, 0], orientation=[1, 0, 0, 0, 1, 0], spacing=[1, 1], slope=2.0, intercept=1.0, rows=2, cols=3)
    data = dicom.encode(head, np.arange(6), [1, 0, 0, 0, 0, 1])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in.dcm", data)
        z.writestr("note.txt", "no image")
    (tmp_path / "x.txt").write_text("no image either")
    assert [r.file for r in dicom.headers(spark, str(tmp_path)).collect()] == ["a.zip/in.dcm"]
    assert [r.val for r in dicom.pixels(spark, str(tmp_path)).orderBy("row", "col").collect()] == [1.0, 3.0, 5.0, 7.0, 9.0, 11.0]
    assert [r.val for r in dicom.pixels(spark, str(tmp_path), overlay=True).orderBy("row", "col").collect()] == [1.0, 0, 0, 0, 0, 1.0]
    assert os.path.exists(tmp_path / "a.zip") and dicom.elements(b"short") is None


def test_clear_stored(spark):
    import os

    from meshlake.operators import stored

    table = stored.stored(spark.range(5))
    path = stored._paths[-1].removeprefix("file://")
    assert table.count() == 5 and os.path.isdir(path)
    assert stored.clear_stored(spark) > 0 and not os.path.isdir(path) and not stored._paths


def test_rounded_cells_keep_the_sign_of_zero(spark):
    from meshlake.plans.matrix_queries import rounded

    vals = [-2e-7, 2e-7, -0.0, 0.0, -0.0000005, 1.0000005, -1.25, 0.0078125, float("inf"), 1e305]
    got = rounded(spark.createDataFrame([(0, vals)], "row_id bigint, vals array<double>")).first().vals
    import duckdb

    assert repr(got) == repr(duckdb.connect().execute("SELECT list_transform(?::DOUBLE[], lambda v: round(v, 6))", [vals]).fetchone()[0])


def test_matrix_queries_equal_sql_as_text(spark, tmp_path):
    """Values that round to zero from below, zeros of both signs and ties, cell by cell with their sign."""
    import duckdb
    import numpy as np

    from meshlake.plans import registry

    v = np.random.default_rng(4).normal(0, 0.125, (240, 64)).astype("float32")
    v[::3, 5], v[::5, 2], v[::4, 60], v[::7, 9] = -0.0, -2e-7, 0.0, np.float32(-7.0 / 128)
    spark.createDataFrame([(k, [float(x) for x in row], k % 10) for k, row in enumerate(v)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("scalar_ops", "expression", "mat_ops", "reshape", "resize", "row_write", "append_remove", "apply_cell", "apply_row"):
        got = {r.row_id: repr(r.vals) for r in registry.QUERIES[f"mat_{name}"](spark, str(tmp_path)).collect()}
        assert got == {k: repr(x) for k, x in con.execute(f"SELECT row_id, vals FROM ({registry.ORACLE_SQL[f'mat_{name}']})").fetchall()}, name
