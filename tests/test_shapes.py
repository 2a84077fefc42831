"""Generated shapes, motion masks and histograms against plain numpy; DICOM, XML and oriented images."""

import base64
import itertools
import math
import os
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import vec
from meshlake.operators import masks, matrix, measures, shapes, stored
from meshlake.sources import binary_images, binary_sinks, dicom, encoded_xml, text_meshes

XYZ = "struct<x:double,y:double,z:double>"


@pytest.mark.parametrize("refine", [0, 2])
def test_sphere(spark, refine):
    nodes, triangles = shapes.sphere(spark, refine)
    at = {r.k: np.array(tuple(r.p)) for r in nodes.collect()}
    faces = [r.corners for r in triangles.collect()]
    assert len(at) == 10 * 4**refine + 2 and len(faces) == 20 * 4**refine and sorted(at) == list(range(len(at)))
    assert all(abs(np.linalg.norm(p) - 1) < 1e-9 for p in at.values())
    edges = Counter((a, b) for f in faces for a, b in zip(f, f[1:] + f[:1]))
    assert all(n == 1 and edges[b, a] == 1 for (a, b), n in edges.items())
    assert all(np.linalg.det([at[k] for k in f]) > 0 for f in faces)
    half, over = shapes.hemisphere(spark, refine)
    assert over.count() == 10 * 4 ** (refine + 1) and half.agg(F.min("p.z")).first()[0] > -1e-9


def test_plane_circle_tube(spark):
    nodes, triangles = shapes.plane(spark, 3)
    at = {r.k: np.array(tuple(r.p)) for r in nodes.collect()}
    areas = [np.cross(at[b] - at[a], at[c] - at[a])[2] / 2 for a, b, c in (r.corners for r in triangles.collect())]
    assert len(at) == 25 and len(areas) == 32 and all(abs(x - 1 / 32) < 1e-12 for x in areas)
    rim, spokes = shapes.circle(spark, 7, 2.0)
    assert rim.count() == 8 and spokes.count() == 7 and rim.where("k = 7 and p.x = 0 and p.y = 0").count() == 1
    line = [("a", k, (math.cos(k / 3), math.sin(k / 3), k / 5), 0.1 + k / 100) for k in range(9)] + [("b", 0, (0.0, 0.0, 0.0), 1.0), ("c", 0, (0.0, 0.0, 0.0), 1.0), ("c", 1, (0.0, 0.0, 2.0), 1.0)]
    df = spark.createDataFrame(line, f"key string, at int, p {XYZ}, radius double")
    nodes, cells = shapes.tubes(df, "key", 6)
    at = {(r.key, r.ring, r.k): np.array(tuple(r.p)) for r in nodes.collect()}
    center = {(k, a): np.array(p) for k, a, p, _ in line}
    assert len(at) == (9 + 2) * 6
    assert all(abs(np.linalg.norm(p - center[key, ring]) - dict(((k, a), r) for k, a, _, r in line)[key, ring]) < 1e-9 for (key, ring, _), p in at.items())
    edges = Counter()
    for r in cells.collect():
        c = [(r.key, x.ring, x.k) for x in r.corners]
        edges.update(zip(c, c[1:] + c[:1]))
    assert set(edges.values()) == {1} and sum(edges[b, a] == 0 for a, b in edges) == 4 * 6
    first = shapes.ribbons(df.where("key = 'c'"), "key", vec.vec(1, 0, 0), 0.5).first()
    assert (tuple(first.a), tuple(first.d)) == ((0.0, 0.25, 0.0), (0.0, -0.25, 2.0))
    board = shapes.billboards(df.where("key = 'b'"), "key", vec.vec(1, 0, 0), vec.vec(0, 1, 0), F.col("radius")).first()
    assert tuple(board.d) == (0.5, 0.5, 0.0)


def test_tube_rings_are_sent_not_their_points(spark):
    """A line that has most rings, one without a key, of one point, of equal points, with an empty point and with a repeated row."""
    far = [("a", k, (math.cos(k / 3), math.sin(k / 3), k / 5), 0.1 + k / 5000) for k in range(500)]
    odd = [(None, 0, (0.0, 0.0, 0.0), 1.0), (None, 1, (0.0, 0.0, 1.0), 1.0), ("b", 0, (0.0, 0.0, 0.0), 1.0), ("c", 0, (1.0, 1.0, 1.0), 1.0), ("c", 1, (1.0, 1.0, 1.0), 1.0)]
    odd += [("d", 0, (0.0, 0.0, 0.0), 1.0), ("d", 1, None, 1.0), ("d", 2, (0.0, 0.0, 2.0), None), ("d", 3, (0.0, 0.0, 3.0), 2.0)] + [("e", k, (0.0, 1.0 * k, 0.0), 0.5) for k in (0, 0, 1, 2)]
    df = spark.createDataFrame(far + odd, f"key string, at int, p {XYZ}, radius double")
    nodes, cells = shapes.tubes(df, "key", 8, rows_per_task=500)
    found = nodes.select("key", "ring", "k", "p", F.spark_partition_id().alias("task")).collect()
    rings = Counter((r.key, r.ring) for r in found)
    assert set(rings.values()) == {8} and Counter(key for key, _ in rings) == {"a": 500, "c": 2, "d": 2, "e": 4}
    center = {("a", k): p for _, k, p, _ in far} | {("c", k): (1.0, 1.0, 1.0) for k in (0, 1)} | {("e", k): p for k, (_, _, p, _) in enumerate(odd[-4:])}
    # A ring whose neighbours tell no direction is its point.
    radius = {("a", k): r for _, k, _, r in far} | {("c", 0): 0.0, ("c", 1): 0.0} | {("e", k): 0.5 if k else 0.0 for k in range(4)}
    assert all(abs(math.dist(tuple(r.p), center[r.key, r.ring]) - radius[r.key, r.ring]) < 1e-9 for r in found if r.key != "d")
    assert {(r.ring, None if r.p.x is None else round(math.hypot(r.p.x, r.p.y), 9), r.p.z) for r in found if r.key == "d"} == {(2, None, None), (3, 2.0, 3.0)}
    assert cells.count() == (499 + 1 + 3 + 3) * 16
    # 513 rings of 8 points are 9 tasks; rings go to them, and nodes of a ring need no other shuffle to meet.
    assert len({r.task for r in found if r.key == "a"}) == 9 and max(Counter(r.task for r in found).values()) < 800
    plan = nodes.groupBy("key", "ring").count()._jdf.queryExecution().executedPlan().toString().splitlines()
    steps = [line for line in plan if "Exchange" in line or "Generate" in line]
    assert "Generate" in steps[0] and "ring" in steps[1]


def test_tube_directions_are_made_once(spark):
    """A filter of units is moved below them and works them out by itself, in code too long to be compiled."""
    line = [("a", k, p, 0.5) for k, p in enumerate([(0.0, 0.0, 0.0), (3.0, 0.0, 0.0), (3.0, 4.0, 0.0), (None, 1.0, 0.0), (3.0, 9.0, 0.0), (3.0, 9.0, 0.0)])]
    nodes, _ = shapes.tubes(spark.createDataFrame(line, f"key string, at int, p {XYZ}, radius double"), "key", 4)
    found = nodes.orderBy("ring", "k").collect()
    at = {(r.ring, r.k): np.array(tuple(r.p), float) for r in found}
    # Ring 0 looks along x and ring 1 between x and y; next to a point without x there is no direction, and the last one, whose neighbour lies at the same place, is its point.
    assert Counter(r.ring for r in found) == {0: 4, 1: 4, 5: 4} and all(tuple(at[5, k]) == (3.0, 9.0, 0.0) for k in range(4))
    along = {0: (1.0, 0.0, 0.0), 1: (0.6, 0.8, 0.0)}
    assert all(abs((at[ring, k] - line[ring][2]) @ way) < 1e-9 and abs(np.linalg.norm(at[ring, k] - line[ring][2]) - 0.5) < 1e-9 for ring, way in along.items() for k in range(4))
    filters = [x for x in nodes._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert filters and not any("SQRT" in x.upper() for x in filters)


def test_line_tubes_reads_its_points_once(spark, tmp_path):
    """Events that come twice, in one second, without a user or a time: what is stored is read, not the events again."""
    import datetime

    from meshlake.plans import registry

    ts = lambda k: datetime.datetime(2024, 1, 1, k % 24, k % 60, 7)
    rows = [(k, ts(k), 1 if k % 4 else k % 3, "x", k * 1.25, "") for k in range(90)] + [(200 + k, ts(k), None, "x", 1.5 * k, "") for k in range(3)]
    rows += [(300, ts(1), 7, "x", 1.0, "")] * 2 + [(301, ts(2), 7, "x", 2.0, ""), (302, None, 7, "x", 3.0, ""), (None, ts(3), 7, "x", 4.0, ""), (400, ts(4), 8, "x", 1.0, "")]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = registry.QUERIES["line_tubes"](spark, str(tmp_path))
    assert found.inputFiles() and not any("events.parquet" in f for f in found.inputFiles())
    got = sorted((r.user_id, r.ring, r.least, r.most, r.n) for r in found.where("user_id < 7").collect())
    want = []
    for user in range(3):
        of = [(k, 0.5 + ts(k).hour / 100) for k, _, u, *_ in rows[:90] if u == user]
        want += [(user, ring, round(r, 6), round(r, 6), 8) for ring, (_, r) in enumerate(of)]
    assert got == want
    # Of user 7, the row that comes twice meets itself as four, and an event without a time has a ring without a size; the lone one of user 8 has none.
    assert Counter(r.user_id for r in found.where("user_id >= 7").collect()) == {7: 6}


def in_triangle(p, corners):
    """Whether a point lies in a closed triangle, which may be a segment or a point."""
    turns = [(b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) for a, b in zip(corners, corners[1:] + corners[:1])]
    if any(turns):
        return min(turns) >= 0 or max(turns) <= 0
    return all(min(c[i] for c in corners) <= p[i] <= max(c[i] for c in corners) for i in (0, 1))


def test_convex_hull(spark):
    rng = np.random.default_rng(4)
    rows, want = [], set()
    for k in range(5):
        points = rng.integers(0, 15, (rng.integers(1, 9), 2)) if k else np.array([[2, 3], [2, 9]])
        rows += [(k, int(r), int(c)) for r, c in points]
        want |= {(k, *p) for p in np.ndindex(15, 15) if any(in_triangle(p, t) for t in map(list, itertools.combinations_with_replacement(points.tolist(), 3)))}
    got = {(r.im, r.row, r.col) for r in masks.convex_hull(spark.createDataFrame(rows, "im int, row int, col int"), ["im"]).collect()}
    assert got == want


def test_motion_mask(spark):
    a = np.zeros((30, 40))
    a[5:12, 6:14] = 9.0
    a[20:24, 30:33] = 8.0
    a += np.random.default_rng(1).uniform(0, 0.1, a.shape)
    df = spark.createDataFrame([(0, *map(int, p), float(v)) for p, v in np.ndenumerate(a)], "im int, row int, col int, motion double")
    got = {(r.row, r.col) for r in masks.motion_mask(df, ["im"], 30, 40, 0.9, 4).collect()}
    inner = np.zeros(a.shape, bool)
    over = a > np.percentile(a, 90)
    inner[1:-1, 1:-1] = over[1:-1, 1:-1] & over[:-2, 1:-1] & over[2:, 1:-1] & over[1:-1, :-2] & over[1:-1, 2:]
    block = {(int(r), int(c)) for r, c in np.argwhere(inner) if r < 15 and c < 20}
    assert got == {(r + i, c + j) for r, c in block for i in range(-1, 3) for j in range(-1, 3)}


def reference_extrema(h, sigma, order):
    h = h.astype(float)
    first = int(np.flatnonzero(h > 0)[0])
    h[first] = 0
    wide = int(4 * sigma + 0.5)
    w = np.exp(-np.arange(-wide, wide + 1) ** 2 / (2 * sigma * sigma))
    padded = np.pad(h, wide, "symmetric")
    s = np.array([(padded[k : k + 2 * wide + 1] * w / w.sum()).sum() for k in range(len(h))])
    beyond = lambda f, i: all(f(s[i], s[min(max(i + k, 0), len(s) - 1)]) for k in range(-order, order + 1) if k)
    peaks = [i for i in range(len(s)) if beyond(lambda a, b: a > b, i)]
    lows = [first] + [i for i in range(len(s)) if beyond(lambda a, b: a < b, i) and i != first]
    return h, peaks, sorted(lows)


def test_histogram_extrema(spark):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(40, 6, 4000), rng.normal(90, 8, 3000), rng.normal(150, 5, 300), np.zeros(5000)]).round().astype(int)
    counts = np.bincount(np.clip(values, 0, 199), minlength=200)
    df = spark.createDataFrame([(int(k), int(n)) for k, n in enumerate(counts)], "bin bigint, n bigint")
    h, peaks, lows = reference_extrema(counts, 3, 5)
    got = measures.histogram_extrema(df, filtered=False).collect()
    assert sorted(r.bin for r in got if r.kind == "max") == peaks and sorted(r.bin for r in got if r.kind == "min") == lows
    limit, kept, beside = h.mean() * 0.5, [], set()
    for i in peaks:
        left, right = max((j for j in lows if j < i), default=None), min((j for j in lows if j > i), default=None)
        if (left is not None and h[i] - h[left] > limit) or (right is not None and h[right] - h[i] > limit):
            kept.append(i)
            beside |= {left, right} - {None}
    got = measures.histogram_extrema(df).collect()
    assert sorted(r.bin for r in got if r.kind == "max") == kept and sorted(r.bin for r in got if r.kind == "min") == sorted(beside)


def test_matrix_of_few_rows(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0])], "row_id bigint, vals array<double>")
    assert matrix.n_rows(one) == 1 and matrix.n_rows(one.limit(0)) == 0
    assert [r.vals for r in matrix.get_at(one, slice(None), slice(None), 2).collect()] == [[1.0, 2.0]]
    assert sorted(r.row_id for r in matrix.append(one, one, matrix.n_rows(one)).collect()) == [0, 1]
    assert [r.row_id for r in matrix.append(one.limit(0), one, matrix.n_rows(one.limit(0))).collect()] == [0]
    assert matrix.get_at(one.limit(0), slice(None), slice(None), 2).count() == 0
    with pytest.raises(ValueError):
        matrix.from_rows(spark.createDataFrame([("a", 1)], "x string, y int"), ["y"], ["x"])


def test_numbered_ties(spark):
    """Equal rows of one key are numbered over many tasks."""
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.lit(1).alias("o"))
    got = stored.numbered(df, ["k"], ["o"], rows_per_task=100)
    ends = got.groupBy("k").agg(F.min("row_id").alias("a"), F.max("row_id").alias("b"), F.count_distinct("row_id").alias("n")).collect()
    assert {(r.a, r.b, r.n) for r in ends} == {(0, 2499, 2500)}


def plane_row(k, **more):
    return {"file": f"{k}.dcm", "series_uid": "1.2", "series_number": 1.0, "description": "d", "instance": float(k), "time": k * 0.5, "position": [0.0, 0.0, float(k % 2)], "orientation": [1.0, 0, 0, 0, 1.0, 0], "spacing": [1.0, 1.0], "slope": 1.0, "intercept": 0.0, "rows": 2, "cols": 3} | more


def test_dicom_values_beyond_16_bits(spark, tmp_path):
    planes = {"a": [0, 1, 2, 3, 4, 65535], "b": [0, 65536, 195000, 1, 2, 3], "c": [-1, 32767, 0, 1, 2, 3], "d": [-70000, 70000, 0, 1, 2, 3]}
    for k, (name, vals) in enumerate(planes.items()):
        (tmp_path / f"{name}.dcm").write_bytes(dicom.encode(plane_row(k), np.array(vals, float)))
    got = dicom.pixels(spark, str(tmp_path)).orderBy("file", "row", "col").collect()
    assert {n: [r.val for r in got if r.file == f"{n}.dcm"] for n in planes} == planes
    with pytest.raises(ValueError):
        dicom.encode(plane_row(0), np.array([0, 0, 0, 0, 0, 2.0**32]))


def test_dicom_damage_and_index(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    whole = {f"{k}.dcm": dicom.encode(plane_row(k), np.arange(6) + k, tags={(0x0010, 0x0020): (b"LO", b"case")}) for k in range(4)}
    for name, data in whole.items():
        (folder / name).write_bytes(data)
    (folder / "cut.dcm").write_bytes(whole["0.dcm"][:-3])
    (folder / "short.dcm").write_bytes(whole["0.dcm"][:150])
    (folder / "packed.dcm").write_bytes(whole["0.dcm"].replace(b"1.2.840.10008.1.2.1", b"1.2.840.10008.1.2.5"))
    (folder / "bad.zip").write_bytes(b"PK\x03\x04 no archive")
    (folder / "note.txt").write_text("hello")
    rows = {r.file: r for r in dicom.headers(spark, str(folder)).collect()}
    assert {f for f, r in rows.items() if r.error} == {"cut.dcm", "short.dcm", "packed.dcm", "bad.zip"} and rows["1.dcm"].series_uid == "1.2" and "note.txt" not in rows
    assert dicom.elements(whole["1.dcm"])[0x0010, 0x0020].strip() == b"case"
    assert {r.file for r in dicom.pixels(spark, str(folder)).select("file").distinct().collect()} == set(whole)
    assert [r.files for r in dicom.series(dicom.headers(spark, str(folder))).collect()] == [["0.dcm", "1.dcm", "2.dcm", "3.dcm"]]
    steps = {r.file: (r.slice, r.step, r.ts) for r in dicom.series_images(dicom.headers(spark, str(folder))).collect()}
    assert steps == {"0.dcm": (0, 0, 0.0), "2.dcm": (0, 1, 1.0), "1.dcm": (1, 0, 0.5), "3.dcm": (1, 1, 1.5)}
    first = dicom.scan(spark, str(folder)).cache()
    assert first.count() == 9 and first.where("error is null and series_uid is null").select("path").collect()
    # A file that changes without a trace in its length or time is not read again.
    at = os.stat(folder / "1.dcm")
    (folder / "1.dcm").write_bytes(whole["1.dcm"].replace(b"1.2\0", b"9.9\0"))
    os.utime(folder / "1.dcm", ns=(at.st_atime_ns, at.st_mtime_ns))
    (folder / "2.dcm").unlink()
    (folder / "9.dcm").write_bytes(dicom.encode(plane_row(9), np.arange(6)))
    again = {r.path.rsplit("/", 1)[1]: r for r in dicom.scan(spark, str(folder), first).collect()}
    assert again["1.dcm"].series_uid == "1.2" and again["1.dcm"].scan == 0 and "2.dcm" not in again
    assert again["9.dcm"].scan == 1 and again["9.dcm"].instance == 9.0 and len(again) == 9


def test_write_binary_refuses(spark):
    df = spark.createDataFrame([("a", b"x")], "file string, content binary")
    for folder in ("hdfs://host/x", "s3a://bucket/x"):
        with pytest.raises(ValueError):
            binary_sinks.write_binary(df, folder)


def test_oriented_images(spark, tmp_path):
    rng = np.random.default_rng(6)
    for k in range(8):
        turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        if k == 0:
            turn = np.diag([-1.0, -1.0, 1.0])
        data = binary_sinks.nifti([2, 3, 4], [1.0, 2.0, 0.5], [3.0, -4.0, 5.0], np.arange(24), turn.ravel().tolist(), 3.5, 20.0)
        for content in (data, data[:252] + struct.pack("<2h", 0, 1) + data[256:]):
            shape, spacing, origin, vals, direction, start, _ = binary_images.nifti(content)
            assert np.allclose(np.array(direction).reshape(3, 3), turn, atol=1e-5) and np.allclose(origin, [3, -4, 5]) and np.allclose(spacing, [1, 2, 0.5]) and start == 3.5
        parsed = binary_images.metaimage(binary_sinks.metaimage([2, 3, 4, 2], [1.0, 2.0, 0.5], [3.0, -4.0, 5.0], np.arange(48), turn.ravel().tolist(), 3.5, 20.0))
        assert np.allclose(np.array(parsed[4]).reshape(3, 3), turn) and parsed[2][:3] == [3.0, -4.0, 5.0] and np.allclose(parsed[5:], (3.5, 20.0))
    text = b"NRRD0004\ntype: short\ndimension: 3\nsizes: 1 1 2\nspace: right-anterior-superior\nspace directions: (2,0,0) (0,3,0) (0,0,4)\nspace origin: (1,2,3)\nencoding: raw\nendian: little\n\n" + b"\1\0\2\0"
    (tmp_path / "a.nrrd").write_bytes(text)
    r = binary_images.placed_pixels(binary_images.volumes(spark, str(tmp_path / "a.nrrd"), "nrrd")).orderBy("z").collect()
    assert [tuple(x.p) for x in r] == [(-1.0, -2.0, 3.0), (-1.0, -2.0, 7.0)] and [x.val for x in r] == [1.0, 2.0]
    grey = binary_sinks.png([2, 1], [1, 1], [0, 0], [5.0, 6.0], stretch=True)
    assert zlib.decompress(grey[41 : 41 + struct.unpack(">I", grey[33:37])[0]]) == b"\0\0\xff"


def test_vtk_cells(spark, tmp_path):
    (tmp_path / "v.vtk").write_text("# vtk DataFile Version 3.0\nt\nASCII\nDATASET UNSTRUCTURED_GRID\nCELLS 4 23\n4 0 1 2 3\n4 0 1 2 3\n8 0 1 2 3 4 5 6 7\n4 3 2 1 0\nCELL_TYPES 4\n9\n10\n12\n8\n")
    got = {r.row_id: (r.geometry, r.node_ids) for r in text_meshes.vtk_cells(spark, str(tmp_path / "v.vtk")).collect()}
    assert got == {0: ("Quad", [0, 1, 3, 2]), 1: ("Tet", [0, 1, 2, 3]), 2: ("Hex", [0, 1, 3, 2, 4, 5, 7, 6]), 3: ("Quad", [3, 2, 1, 0])}


def vtu(arrays, appended="", head=""):
    return f'<?xml version="1.0"?><VTKFile type="UnstructuredGrid" byte_order="LittleEndian" {head}><UnstructuredGrid><Piece><Points>{arrays}</Points></Piece></UnstructuredGrid>{appended}</VTKFile>'


def test_vtk_xml_encodings(spark, tmp_path):
    a = np.arange(12, dtype="<f4").reshape(4, 3) / 4
    raw = a.tobytes()
    b64 = lambda b: base64.b64encode(b).decode()
    packed = [zlib.compress(raw[:20]), zlib.compress(raw[20:40]), zlib.compress(raw[40:])]
    sizes = struct.pack("<6Q", 3, 20, 8, *map(len, packed))
    tag = lambda form, text, more="": f'<DataArray type="Float32" Name="P" NumberOfComponents="3" format="{form}" {more}>{text}</DataArray>'
    files = {
        "ascii": vtu(tag("ascii", " ".join(map(str, a.ravel())))), "one": vtu(tag("binary", b64(struct.pack("<I", len(raw)) + raw))), "two": vtu(tag("binary", b64(struct.pack("<I", len(raw))) + b64(raw))),
        "packed": vtu(tag("binary", b64(sizes) + b64(b"".join(packed))), head='header_type="UInt64" compressor="vtkZLibDataCompressor"'),
        "appended": vtu(tag("appended", "", 'offset="0"'), f'<AppendedData encoding="base64">_{b64(struct.pack("<I", len(raw)) + raw)}</AppendedData>'),
    }
    for name, text in files.items():
        (tmp_path / f"{name}.vtu").write_text(text)
    start, end = vtu(tag("appended", "", 'offset="3"'), '<AppendedData encoding="raw">_|</AppendedData>').split("|")
    (tmp_path / "raw.vtu").write_bytes(start.encode() + b"xyz" + struct.pack("<I", len(raw)) + raw + end.encode())
    got = encoded_xml.vtk_xml(spark, str(tmp_path)).collect()
    assert len(got) == 4 * 6 and all(r.section == "Points" and r.array == "P" and np.allclose(r.vals, a[r.row_id]) for r in got)


def test_x4df(spark, tmp_path):
    nodes, moved, ids = np.arange(6.0).reshape(2, 3), np.ones((2, 3)), np.array([[0, 1]])
    array = lambda name, v, form, kind, more="": f'<array name="{name}" shape="{v.shape[0]} {v.shape[1]}" type="{kind}" format="{form}" {more}>{"" if more else encoded_xml.encode_array(v, form, kind).decode()}</array>'
    (tmp_path / "m.x4df").write_text(
        '<x4df><mesh name="m" timescheme="10 5"><nodes src="n0"/><nodes src="n1" initialnodes="n0"/><topology name="lines" src="t" elemtype="Line1NL"/><field name="f" src="f" toponame="lines" fieldtype="elem"/></mesh>'
        + array("n0", nodes, "base64_gz", "f8") + array("n1", moved, "binary_gz", "f4", 'filename="side.dat"') + array("t", ids, "ascii", "u4") + array("f", np.array([[2.5]]), "base64", "f4") + "</x4df>"
    )
    (tmp_path / "side.dat").write_bytes(encoded_xml.encode_array(moved, "binary_gz", "f4"))
    got = {(r.kind, r.number, r.row_id): (r.ts, r.vals) for r in encoded_xml.x4df(spark, str(tmp_path)).collect()}
    assert got == {("nodes", 0, 0): (10.0, [0, 1, 2]), ("nodes", 0, 1): (10.0, [3, 4, 5]), ("nodes", 1, 0): (15.0, [1, 2, 3]), ("nodes", 1, 1): (15.0, [4, 5, 6]), ("topology", 0, 0): (None, [0, 1]), ("field", 0, 0): (10.0, [2.5])}
    assert [r.per_element for r in encoded_xml.x4df(spark, str(tmp_path)).where("kind = 'field'").collect()] == [True]


def test_par_rec(spark, tmp_path):
    row = lambda sl, typ, slope, inter, trig: " ".join(map(str, [sl, 1, 1, 2, typ, 1, 0, 16, 80, 3, 2, inter, slope, 1.0, *[0] * 18, trig, *[0] * 9]))
    (tmp_path / "a.par").write_text("# header\n.    Patient name : x\n" + row(1, 0, 2.0, 1.0, 10.5) + "\n" + row(2, 3, 1.0, 0.0, 20.0) + "\n")
    (tmp_path / "a.rec").write_bytes(np.arange(12, dtype="<u2").tobytes())
    got = {(r.slice, r.row, r.col): (r.image_type, r.phase, r.ts, r.val) for r in text_meshes.par_pixels(spark, str(tmp_path)).collect()}
    assert len(got) == 12 and got[1, 1, 2] == (0, 2, 10.5, 11.0) and got[2, 0, 0] == (3, 2, 20.0, 6.0)


def test_nearest_over_many_tasks(spark):
    from meshlake.operators import timeseries

    rng = np.random.default_rng(2)
    steps = [(k % 2, float(t), k) for k, t in enumerate(rng.integers(0, 500, 300))]
    times = [(k % 3, float(t), k) for k, t in enumerate(rng.uniform(-20, 520, 400))]
    a = spark.createDataFrame(times, "key int, t double, id int")
    b = spark.createDataFrame(steps, "key int, s double, tie int")
    for most in (50, 1_000_000):
        got = {r.id: (r.nearest_time, r.nearest_id) for r in timeseries.nearest(a, b, ["key"], "t", "s", "tie", most).collect()}
        want = {}
        for key, t, i in times:
            near = min(((abs(s - t), tie, s) for k, s, tie in steps if k == key), default=None)
            want[i] = (near[2], near[1]) if near else (None, None)
        assert got == want
    pairs = {r.id: r.next_value for r in timeseries.successive(a, ["key"], ["t"], "id", cyclic=True).collect()}
    order = {k: [i for _, i in sorted((t, i) for key, t, i in times if key == k)] for k in range(3)}
    assert pairs == {i: o[(j + 1) % len(o)] for o in order.values() for j, i in enumerate(o)}
