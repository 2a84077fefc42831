import gzip
import struct

import numpy as np
from pyspark.sql import functions as F

from meshlake.functions import basis, strings
from meshlake.operators import mesh, spatial
from meshlake.sources import binary_images, text_meshes
from meshlake.streaming import events


def test_cheart_round_trip(spark, tmp_path):
    (tmp_path / "a0003.X").write_text("3 3\n0 0 0\n1 0\n 0\n0 1 0.5\n")
    (tmp_path / "a.T").write_text("2 3\n1 2 3\n3 2\n1\n")
    x = {r.row_id: list(r.vals) for r in text_meshes.cheart_values(spark, str(tmp_path / "a0003.X")).collect()}
    assert x == {0: [0, 0, 0], 1: [1, 0, 0], 2: [0, 1, 0.5]}
    t = {r.row_id: list(r.node_ids) for r in text_meshes.cheart_topology(spark, str(tmp_path / "a.T")).collect()}
    assert t == {0: [0, 1, 2], 1: [2, 1, 0]}
    step = text_meshes.files(spark, str(tmp_path / "a0003.X")).select(text_meshes.timestep(F.col("file")).alias("s")).first().s
    assert step == 3
    out = text_meshes.cheart_values(spark, str(tmp_path / "a0003.X")).withColumn("name", F.lit("b"))
    text_meshes.write_cheart(out, str(tmp_path / "out"))
    again = {r.row_id: list(r.vals) for r in text_meshes.cheart_values(spark, str(tmp_path / "out/name=b")).collect()}
    assert again == x


def test_medit_stl_vtk(spark, tmp_path):
    (tmp_path / "m.mesh").write_text("MeshVersionFormatted 1\nDimension 3\nVertices 2\n0 0 0 1\n1 2 3 1\nEdges\n1\n1 2 7\nEnd\n")
    m = {(r.section, r.row_id): list(r.vals) for r in text_meshes.medit(spark, str(tmp_path / "m.mesh")).collect()}
    assert m == {("Vertices", 0): [0, 0, 0], ("Vertices", 1): [1, 2, 3], ("Edges", 0): [0, 1]}
    (tmp_path / "s.stl").write_text("solid s\nfacet normal 0 0 1\n outer loop\n vertex 0 0 0\n vertex 1 0 0\n vertex 0 1e0 0\n endloop\nendfacet\nendsolid\n")
    r = text_meshes.stl(spark, str(tmp_path / "s.stl")).collect()
    assert [list(r[0].normal), [list(c) for c in r[0].corners]] == [[0, 0, 1], [[0, 0, 0], [1, 0, 0], [0, 1, 0]]]
    (tmp_path / "v.vtk").write_text("# vtk DataFile Version 3.0\nt\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS 3 float\n0 0 0 1 0 0\n0 1 0\nCELLS 1 4\n3 0 1 2\nCELL_TYPES 1\n5\n")
    assert [list(r.vals) for r in text_meshes.vtk_points(spark, str(tmp_path / "v.vtk")).orderBy("row_id").collect()] == [[0, 0, 0], [1, 0, 0], [0, 1, 0]]
    assert [list(r.node_ids) for r in text_meshes.vtk_cells(spark, str(tmp_path / "v.vtk")).collect()] == [[0, 1, 2]]


def test_key_values(spark, tmp_path):
    (tmp_path / "c.ini").write_text("# c\n[a]\nx = 1\ny=2 = 3\n")
    assert {(r.section, r.key, r.value) for r in text_meshes.key_values(spark, str(tmp_path / "c.ini")).collect()} == {("a", "x", "1"), ("a", "y", "2 = 3")}


def test_images(spark, tmp_path):
    vals = np.arange(24, dtype="<i2")
    (tmp_path / "a.mha").write_bytes(b"NDims = 3\nDimSize = 2 3 4\nElementSpacing = 1 2 3\nElementType = MET_SHORT\nElementDataFile = LOCAL\n" + vals.tobytes())
    p = binary_images.pixels(binary_images.volumes(spark, str(tmp_path / "a.mha"), "metaimage")).collect()
    assert all(r.val == r.x + 2 * r.y + 6 * r.z and r.t == 0 for r in p) and len(p) == 24
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 2, 3, 4, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<8f", head, 76, 1, 1, 2, 3, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 2, 1)
    (tmp_path / "a.nii.gz").write_bytes(gzip.compress(bytes(head) + vals.tobytes()))
    v = binary_images.volumes(spark, str(tmp_path / "a.nii.gz"), "nifti").first()
    assert list(v.shape) == [2, 3, 4] and list(v.vals) == [2.0 * k + 1 for k in range(24)]
    (tmp_path / "a.nrrd").write_bytes(b"NRRD0004\ntype: short\ndimension: 3\nsizes: 2 3 4\nencoding: raw\nendian: little\n\n" + vals.tobytes())
    assert list(binary_images.volumes(spark, str(tmp_path / "a.nrrd"), "nrrd").first().vals) == list(range(24))
    (tmp_path / "r.bin").write_bytes(vals.tobytes())
    assert [list(r.vals) for r in binary_images.raw_matrix(spark, str(tmp_path / "r.bin"), "<i2", 12).orderBy("row_id").collect()][1] == list(range(12, 24))


def test_generated_box(spark):
    nodes, elements = mesh.box_grid(spark, 3, 2, 2)
    assert (nodes.count(), elements.count()) == (36, 12)
    assert spatial.external(mesh.faces(elements, "Hex")).count() == 2 * (3 * 2 + 3 * 2 + 2 * 2)
    centers = mesh.positions(elements, nodes, "Hex1NL", [(0.5, 0.5, 0.5)]).agg(F.avg("p.x").alias("x"), F.avg("p.z").alias("z")).first()
    assert abs(centers.x - 0.5) < 1e-9 and abs(centers.z - 0.5) < 1e-9
    cut = mesh.slice_plane(elements, nodes, (0.4, 0, 0), (1, 0, 0), "Hex").select("p.x").distinct().collect()
    assert len({round(r.x, 9) for r in cut}) == 1
    assert mesh.triangulate(elements, "Hex").count() == 12 * 12


def test_lagrange_is_nodal():
    for geometry, order in (("Line", 3), ("Tri", 2), ("Quad", 2), ("Tet", 2), ("Hex", 1)):
        powers, at = np.array(basis.exponents(geometry, order)), basis.node_positions(geometry, order)
        values = np.prod(at[:, None, :] ** powers[None], 2) @ basis.lagrange_coefficients(geometry, order).T
        assert np.allclose(values, np.eye(len(at)))


def test_selection():
    assert strings.selection("1,6-8,9-2-14", 20) == [1, 6, 7, 9, 11, 13]


def test_stream_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = events.windowed(events.read_stream(spark, str(tmp_path / "in"), src.schema), "ts", ["event_type"], "value")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.sql("SELECT * FROM windows")) == key(events.windowed(src, "ts", ["event_type"], "value"))


def test_unique_names_beyond_99(spark):
    df = spark.range(1234).select("id", F.lit("a").alias("name")).union(spark.createDataFrame([(0, "b"), (1, "b"), (2, None)], "id bigint, name string"))
    got = [r.unique_name for r in strings.unique_names(df, "name", "id").orderBy("name", "id").collect()]
    assert got == [None, "a", *(f"a_{k:02d}" for k in range(1, 1234)), "b", "b_01"]


def test_stores_of_many_names_are_whole_files(spark, tmp_path):
    """Both parts come dealt by name and are large enough to be read by several tasks."""
    e = spark.range(400 * 300).groupBy((F.col("id") % 300).cast("string").alias("name")).agg(F.collect_list(F.sha2(F.col("id").cast("string"), 512)).alias("e"))
    part = lambda key: e.select("name", F.lit(key).alias("key"), F.array_join("e", " ").alias("value"))
    text_meshes.write_key_values(part("a").unionByName(part("b")).withColumn("section", F.lit("s")), str(tmp_path / "out"))
    assert all(len(list(f.glob("*.txt"))) == 1 for f in (tmp_path / "out").glob("name=*"))
    assert text_meshes.stores(spark, str(tmp_path / "out")).where("section = 's'").count() == 600


def test_measure_files_are_gathered_by_few_tasks(spark, tmp_path):
    """A user who has most events, events that come twice, without a user, a time or a value."""
    import datetime

    from meshlake.plans import registry

    ts = lambda k: datetime.datetime(2024, 1, 1, k % 24, 0, 0)
    rows = [(k, ts(k), 1 if k % 5 else 2 + k % 40, "x", k / 8, "") for k in range(400)] + [(500, ts(1), 90, "x", 1.5, "")] * 2
    rows += [(600, ts(2), None, "x", 2.5, ""), (700, None, 91, "x", 3.5, ""), (701, ts(3), 91, "x", None, "")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["measure_files"](spark, str(tmp_path))
    got = {r.name: (r.timesteps, r.vals) for r in found.collect()}
    want = {str(u): ([float(k) for k, _, v, *_ in rows[:400] if v == u], [[round(x, 3), float(t.hour)] for _, t, v, _, x, _ in rows[:400] if v == u]) for u in {r[2] for r in rows[:400]}}
    want |= {"90": ([500.0] * 2, [[1.5, 1.0]] * 2), "91": ([700.0, 701.0], [[3.5, None], [None, 3.0]]), "__HIVE_DEFAULT_PARTITION__": ([600.0], [[2.5, 2.0]])}
    assert got == want
    # From the top of the plan down: the aggregation, then the exchange, then the lines; the tasks that read the files sum nothing up.
    steps = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if any(x in line for x in ("Aggregate", "Repartition", "Generate"))]
    assert "Aggregate" in steps[0] and "Repartition" in steps[1] and "Generate" in steps[2]


def test_long_files_do_not_take_time_by_their_square(spark, tmp_path):
    """Without what goes along with each row, both files are read in seconds; with it in many minutes."""
    import time

    rows = spark.range(40_000).select(F.lit("a1").alias("name"), F.col("id").alias("row_id"), F.array(F.col("id") + 0.5, F.col("id") * 2.0).alias("vals"))
    text_meshes.write_vtu(rows.withColumn("array", F.lit("points")), str(tmp_path / "vtu"))
    text_meshes.write_matrix(rows, str(tmp_path / "matrix"), "matrix", {"unit": "mm"})
    start = time.perf_counter()
    for found in (text_meshes.vtu_arrays(spark, str(tmp_path / "vtu")), text_meshes.matrices(spark, str(tmp_path / "matrix")).where("meta['unit'] = 'mm'")):
        assert found.join(rows.withColumnRenamed("vals", "want"), ["name", "row_id"]).where("vals = want").count() == 40_000
    assert time.perf_counter() - start < 60
