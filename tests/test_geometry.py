"""Rays, element search, surfaces, outlines, sampling, strain, transforms and splines against plain numpy."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlake.functions import basis, vec
from meshlake.operators import fields, grid, lines, outlines, rays, search, spatial, surfaces, volumes

XYZ = "struct<x:double,y:double,z:double>"


def triangles_of(rng, n):
    corners = rng.uniform(-1, 1, (n, 1, 3)) + rng.uniform(-0.2, 0.2, (n, 3, 3))
    corners[:3] *= 20  # large ones beside small ones
    corners[3, 1] = corners[3, 0]  # flat
    corners[4, :, 2] = 0.0  # in a plane between cells
    return corners


def brute_ray(o, d, tri):
    e, f = tri[1] - tri[0], tri[2] - tri[0]
    h = np.cross(d, f)
    det = e @ h
    if abs(det) <= 1e-10:
        return None
    s = o - tri[0]
    u, q = s @ h / det, np.cross(s, e)
    v, t = d @ q / det, f @ q / det
    return t if u >= 0 and v >= 0 and u + v <= 1 and t >= 0 else None


@pytest.mark.parametrize("size", [0.05, 0.3, 5.0])
def test_cast(spark, size):
    rng = np.random.default_rng(1)
    corners = triangles_of(rng, 60)
    origins, ways = rng.uniform(-1.5, 1.5, (40, 3)), rng.normal(size=(40, 3))
    ways[0], ways[1], origins[1] = (0, 0, 1), (1, 0, 0), (-3, 0, 0)
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    tris = spark.createDataFrame([(k, *(tuple(map(float, p)) for p in c)) for k, c in enumerate(corners)], f"tri_id bigint, a {XYZ}, b {XYZ}, c {XYZ}")
    df = spark.createDataFrame([(k, tuple(map(float, o)), tuple(map(float, d))) for k, (o, d) in enumerate(zip(origins, ways))], f"ray_id bigint, origin {XYZ}, direction {XYZ}")
    hits = rays.cast(df, tris, size)
    got = {(r.ray_id, r.tri_id): r.t for r in hits.collect()}
    want = {(i, j): t for i in range(40) for j in range(60) if (t := brute_ray(origins[i], ways[i], corners[j])) is not None}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 * (1 + want[k]) for k in want)
    assert hits.count() == len(got)
    first = {r.ray_id: r.tri_id for r in rays.first_hits(hits).collect()}
    assert first == {i: min((t, j) for (a, j), t in want.items() if a == i)[1] for i in {k[0] for k in want}}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert rays.cast(df, tris.limit(0), size).count() == 0 and rays.cast(df.limit(0), tris, size).count() == 0


def test_nearest_hits(spark):
    """First hits without the others: rays that hit soon, late and never, some of which may not hit one of the triangles."""
    rng = np.random.default_rng(2)
    corners, origins, ways = triangles_of(rng, 80), rng.uniform(-1.5, 1.5, (30, 3)), rng.normal(size=(30, 3))
    origins[0], ways[0] = (90, 90, 90), (0, 0, 1)
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    tris = spark.createDataFrame([(k, *(tuple(map(float, p)) for p in c)) for k, c in enumerate(corners)], f"tri_id bigint, a {XYZ}, b {XYZ}, c {XYZ}")
    whole = {r: min(((t, j) for j in range(80) if j != r and (t := brute_ray(origins[r], ways[r], corners[j])) is not None), default=None) for r in range(30)}
    df = spark.createDataFrame([(k, k, tuple(map(float, o)), tuple(map(float, d))) for k, (o, d) in enumerate(zip(origins, ways))], f"ray_id bigint, skip bigint, origin {XYZ}, direction {XYZ}")
    got = {r.ray_id: (r.t, r.tri_id) for r in rays.nearest(df, tris, 0.3).collect()}
    assert got.keys() == {r for r, v in whole.items() if v} and all(got[r][1] == whole[r][1] and abs(got[r][0] - whole[r][0]) < 1e-6 * (1 + got[r][0]) for r in got)
    assert 0 not in got and rays.nearest(df, tris.limit(0), 0.3).count() == 0 and rays.nearest(df.limit(0), tris, 0.3).count() == 0


def test_region_thickness(spark):
    """Two parallel plates: rays of each meet the other at their distance."""
    rows = []
    for k, z in enumerate((0.0, 0.25)):
        for i, j in itertools.product(range(4), range(4)):
            p = [(i, j, z), (i + 1, j, z), (i, j + 1, z), (i + 1, j + 1, z)]
            for part in ((0, 1, 2), (1, 3, 2)):
                corners = [tuple(map(float, p[m])) for m in (part if k else part[::-1])]
                rows.append((len(rows), k, *corners))
    tris = spark.createDataFrame(rows, f"tri_id bigint, region int, a {XYZ}, b {XYZ}, c {XYZ}")
    got = {r.region: (round(r.trimmed_mean, 9), r.n_kept) for r in rays.region_thickness(tris, ["region"], 1.0).collect()}
    assert got == {0: (0.25, 32), 1: (0.25, 32)}


def brute_shapes(name, xi):
    geometry, order, _ = basis.element_type(name)
    powers = np.array(basis.exponents(geometry, order))
    return basis.lagrange_coefficients(geometry, order) @ np.prod(np.asarray(xi) ** powers, 1)


@pytest.mark.parametrize("name", ["Hex1NL", "Tet2NL", "Hex2NL", "Tet1NL"])
def test_locate_in_elements(spark, name):
    rng = np.random.default_rng(3)
    geometry, order, _ = basis.element_type(name)
    places = basis.node_positions(geometry, order)
    nodes, elements, points = [], [], []
    for e in range(12):
        corners = places * (8.0 if e == 0 else 1.0) + [3.0 * e, 0, 0] + rng.uniform(-0.08, 0.08, places.shape)
        ids = [len(nodes) + k for k in range(len(corners))]
        nodes += [(i, tuple(map(float, p))) for i, p in zip(ids, corners)]
        elements.append((e, ids))
        for _ in range(6):
            xi = rng.uniform(0.02, 0.98, 3)
            if geometry == "Tet":
                xi = xi / (xi.sum() + 0.1)
            points.append((len(points), e, xi, brute_shapes(name, xi) @ corners))
    elements.append((99, [10**6] * len(places)))
    df = spark.createDataFrame([(i, tuple(map(float, p))) for i, _, _, p in points] + [(10**6, (-50.0, 0.0, 0.0))], f"id bigint, p {XYZ}")
    found = search.locate(df, spark.createDataFrame(elements, "elem_id bigint, node_ids array<bigint>"), spark.createDataFrame(nodes, f"node_id bigint, p {XYZ}"), name, 1.0)
    got = {(r.id, r.elem_id): r.xi for r in found.collect()}
    assert len(got) == found.count() and not any(i == 10**6 for i, _ in got)
    for i, e, xi, _ in points:
        assert np.abs(np.array(got[i, e]) - xi).max() < 1e-8


def test_locate_sends_corners_once(spark):
    """Elements that bring their corners; only boxes go to the cells, and corners neither with them nor in a broadcast."""
    places = basis.node_positions("Hex", 1)
    cubes = [(e, [tuple(map(float, p + [1.0 * e, 0, 0])) for p in places]) for e in range(6)] + [(6, [None] * 8), (7, [(0.0, 0.0, 0.0)] * 7), (8, None)]
    elements = spark.createDataFrame(cubes, f"elem_id bigint, cnodes array<{XYZ}>")
    df = spark.createDataFrame([(0, (0.25, 0.5, 0.75)), (1, (3.0, 0.5, 0.5)), (2, (9.0, 0.0, 0.0)), (3, None)], f"id bigint, p {XYZ}")
    found = search.locate(df, elements, None, "Hex1NL", 1.0)
    got = {(r.id, r.elem_id): [round(v, 9) for v in r.xi] for r in found.collect()}
    assert got == {(0, 0): [0.25, 0.5, 0.75], (1, 2): [1.0, 0.5, 0.5], (1, 3): [0.0, 0.5, 0.5]}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    boxes = next(line for line in plan.split("\n") if "xxhash64" in line and "_ax" in line)
    assert "cnodes" not in boxes and "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_newton_steps_end(monkeypatch):
    """Points that have come to their place take no further steps; coordinates are found as before, of points outside none."""
    rng, solve, rows = np.random.default_rng(2), np.linalg.solve, []
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: rows.append(len(a)) or solve(a, b))
    for name, bend in (("Hex1NL", 0.1), ("Tet2NL", 0.04), ("Tri2NL", 0.04)):
        geometry, order, _ = basis.element_type(name)
        places, n = basis.node_positions(geometry, order), 500
        corners = np.pad(places, ((0, 0), (0, 3 - places.shape[1])))[None] + rng.uniform(-bend, bend, (n, len(places), 3))
        xi = rng.uniform(0.02, 0.32, (n, places.shape[1]))
        weights = np.array([basis.weights_at(geometry, order, tuple(x)) for x in xi])
        points = np.einsum("ni,nic->nc", weights, corners)
        rows.clear()
        assert np.abs(search.invert(corners, points, geometry, order, 12, 2, 1e-9) - xi).max() < 1e-9
        assert sum(rows) < 8 * n
        assert np.isnan(search.invert(corners[:50], points[:50] + 1.2, geometry, order, 12, 2, 1e-9)).all()


def test_meeting_of_dense_cells(spark, monkeypatch):
    """All tetrahedra about one place: their cells are cut into parts, their pairs into pieces, and every pair still meets once."""
    rng = np.random.default_rng(8)
    tets, points = rng.normal(0, 0.2, (300, 4, 3)), rng.normal(0, 0.1, (40, 3))
    row = lambda k, c: (k, *(tuple(map(float, p)) for p in c))
    shape = spark.createDataFrame([row(k, c) for k, c in enumerate(tets)] + [(300, *[(0.1, 0.1, 0.1)] * 4), (301, None, *[(0.1, 0.1, 0.1)] * 3)], "elem_id bigint, " + ", ".join(f"{c} {XYZ}" for c in "abcd"))
    df = spark.createDataFrame([row(k, [p]) for k, p in enumerate(points)] + [(40, None)], f"id bigint, p {XYZ}")
    xi = np.linalg.solve(np.swapaxes(tets[:, 1:] - tets[:, :1], 1, 2)[None], (points[:, None] - tets[None, :, 0])[..., None])[..., 0]
    want = {(i, j) for i, j in zip(*np.nonzero((xi >= 0).all(2) & (xi.sum(2) <= 1)))}
    whole, seen = grid.meeting, []
    monkeypatch.setattr(spatial, "meeting", lambda a, b, run, schema: seen.append(b) or whole(a, b, run, schema, 16))
    found = spatial.locate(df, shape, 0.1).collect()
    assert len(want) > 200 and len(found) == len(want) and {(r.id, r.elem_id) for r in found} == want
    assert all(np.allclose(list(r.xi), xi[r.id, r.elem_id], atol=1e-6) for r in found)
    assert seen[0].groupBy(*grid.CELL).count().agg(F.max("count")).first()[0] > 100
    assert spatial.locate(df, shape.limit(0), 0.1).count() == 0 and spatial.locate(df.limit(0), shape, 0.1).count() == 0


def test_loft_rows_are_made_by_many_tasks(spark):
    """A surface of many rings is not one task's; its closed triangles are as many as before."""
    rings = spark.range(4 * 1500).select(F.lit(1).alias("key"), F.floor(F.col("id") / 4).alias("level"), (F.col("id") % 4).alias("k"), vec.vec(F.col("id") % 4 * 1.0, F.floor(F.col("id") / 4) * 1.0, 0.0).alias("p"))
    for closed, caps in ((True, 4), (False, 0)):
        _, faces = surfaces.loft(rings, "key", 4, 2, closed)
        made = faces.groupBy(F.spark_partition_id()).count().collect()
        assert len(made) > 2 and sum(r["count"] for r in made) == faces.distinct().count() == 2 * 4 * 3 * 1499 + caps
    assert surfaces.loft(rings.limit(0), "key", 4, 2)[1].count() == 0 and surfaces.loft(rings.where("level = 0"), "key", 4, 2, False)[1].count() == 0


def test_bernstein_hull():
    for name in ("Hex2NL", "Tet2NL", "Tri3NL", "Line2NL"):
        geometry, order, _ = basis.element_type(name)
        rng = np.random.default_rng(5)
        nodes = rng.normal(size=(len(basis.exponents(geometry, order)), 3))
        hull = search.bernstein_matrix(geometry, order) @ nodes
        dims = basis.GEOMETRIES[geometry][0]
        for xi in rng.uniform(0, 1, (200, dims)):
            xi = xi / max(1, xi.sum()) if basis.GEOMETRIES[geometry][1] else xi
            p = brute_shapes(name, xi) @ nodes
            assert (p >= hull.min(0) - 1e-9).all() and (p <= hull.max(0) + 1e-9).all()


def hex_grid(n):
    at = lambda i, j, k: i + (n + 1) * (j + (n + 1) * k)
    nodes = {at(i, j, k): (i, j, k) for i, j, k in itertools.product(range(n + 1), repeat=3)}
    cells = [(at(i, j, k), [at(i + a, j + b, k + c) for c in (0, 1) for b in (0, 1) for a in (0, 1)]) for i, j, k in itertools.product(range(n), repeat=3)]
    return nodes, cells


@pytest.mark.parametrize("geometry", ["Hex", "Tet"])
def test_iso_surface_is_closed(spark, geometry):
    """Random values inside, low ones at the border: every edge has one triangle on each side, and the volume within is that of a sum of signed tetrahedra."""
    n, rng = 5, random.Random(4)
    nodes, cells = hex_grid(n)
    if geometry == "Tet":
        # Six tetrahedra along the diagonal from the first corner to the last: the same way in all cells.
        paths = [(0, 1, 3, 7), (0, 1, 5, 7), (0, 2, 3, 7), (0, 2, 6, 7), (0, 4, 5, 7), (0, 4, 6, 7)]
        corners = np.array([nodes[i] for i in range(len(nodes))], float)
        turned = lambda ids: ids if np.linalg.det(corners[ids[1:]] - corners[ids[0]]) > 0 else [ids[0], ids[2], ids[1], ids[3]]
        cells = [(e * 6 + k, turned([ids[c] for c in path])) for e, ids in cells for k, path in enumerate(paths)]
    rows = [(i, tuple(map(float, p)), 0.0 if 0 in p or n in p else rng.random()) for i, p in nodes.items()]
    frame = spark.createDataFrame(rows, f"node_id bigint, p {XYZ}, val double")
    found = surfaces.iso_surface(spark.createDataFrame(cells, "elem_id bigint, node_ids array<bigint>"), frame, geometry, [0.2, 0.5, 0.9])
    triangles = found.collect()
    for iso in (0.2, 0.5, 0.9):
        edges, volume = Counter(), 0.0
        for r in (t for t in triangles if t.iso == iso):
            names = [(v.low, v.high) for v in (r.a, r.b, r.c)]
            assert all(a < b for a, b in names)
            edges.update(zip(names, names[1:] + names[:1]))
            volume += np.linalg.det([tuple(v.p) for v in (r.a, r.b, r.c)]) / 6
        assert edges and all(m == 1 and edges[b, a] == 1 for (a, b), m in edges.items())
        assert 0 < volume < n**3
    shared = surfaces.vertices(found).collect()
    assert len({(v.iso, v.low, v.high) for v in shared}) == len(shared)
    places = {(t.iso, v.low, v.high): v.p for t in triangles for v in (t.a, t.b, t.c)}
    assert all(places[v.iso, v.low, v.high] == v.p for v in shared)


def test_case_table():
    table = surfaces.case_table("Hex")
    assert len(table) == 256 and table[0] == table[255] == []
    assert max(len(t) for t in table) <= 5 and len(surfaces.case_table("Tet")) == 16
    assert all(len(t) == (1 if case.bit_count() in (1, 3) else 2) for case, t in enumerate(surfaces.case_table("Tet")) if 0 < case < 15)


def test_slice_of_hexahedra(spark):
    nodes, cells = hex_grid(3)
    frame = spark.createDataFrame([(i, tuple(map(float, p))) for i, p in nodes.items()], f"node_id bigint, p {XYZ}")
    found = surfaces.slice_surface(spark.createDataFrame(cells, "elem_id bigint, node_ids array<bigint>"), frame, "Hex", vec.vec(1.5, 0, 0), vec.vec(1, 0, 0))
    area = found.select(F.sum(vec.triangle_area(F.col("a.p"), F.col("b.p"), F.col("c.p"))).alias("s"), F.min("a.p.x").alias("x")).first()
    assert abs(area.s - 9) < 1e-9 and area.x == 1.5 and found.select("elem_id").distinct().count() == 9


def test_outlines(spark):
    rng = random.Random(6)
    rows = [(k, r, c) for k in range(4) for r in range(14) for c in range(17) if rng.random() < (0.35, 0.6, 0.85, 1.0)[k]]
    mask = spark.createDataFrame(rows, "image int, row int, col int")
    found = outlines.outlines(mask, ["image"])
    loops = defaultdict(dict)
    for r in found.collect():
        loops[r.image, tuple(r.loop)][r["at"]] = r
    pixels = {k: {(r, c) for i, r, c in rows if i == k} for k in range(4)}
    areas, sides = Counter(), Counter()
    for (image, _), points in loops.items():
        n = len(points)
        assert sorted(points) == list(range(n)) and all(p.n == n for p in points.values())
        ring = [(points[k].x, points[k].y) for k in range(n)]
        assert all(abs(a - x) + abs(b - y) == 1 for (a, b), (x, y) in zip(ring, ring[1:] + ring[:1]))
        area = sum(a * y - x * b for (a, b), (x, y) in zip(ring, ring[1:] + ring[:1])) / 2
        assert area == points[0].area
        areas[image] += area
        sides[image] += n
    assert areas == {k: len(p) for k, p in pixels.items()}
    assert sides == {k: sum((r + a, c + b) not in p for r, c in p for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))) for k, p in pixels.items()}
    objects = volumes.objects(mask, ["image"]).select("image", "object").distinct().groupBy("image").count()
    outer = Counter(image for (image, _), p in loops.items() if p[0].area > 0)
    assert {r.image: r["count"] for r in objects.collect()} == outer
    corners = outlines.turning_points(found).where("image = 3").collect()
    assert {(r.p.x, r.p.y) for r in corners} == {(0, 0), (17, 0), (17, 14), (0, 14)}
    assert outlines.outlines(mask.limit(0), ["image"]).count() == 0


@pytest.mark.parametrize("dims", [2, 3])
def test_maximal_points(spark, dims):
    rng = np.random.default_rng(dims)
    places = np.concatenate([rng.uniform(0, 1, (300, dims)), np.full((100, dims), 0.5), 0.5 + rng.uniform(-1e-3, 1e-3, (100, dims))])
    names = ("x", "y", "z")[:dims]
    df = spark.createDataFrame([(k, *map(float, p), int(w)) for k, (p, w) in enumerate(zip(places, rng.integers(0, 50, len(places))))], ", ".join(["id bigint", *(f"{c} double" for c in names), "w int"]))
    got = {r.id for r in spatial.maximal_points(df, 0.15, "w", names).collect()}
    want = []
    for r in sorted(df.collect(), key=lambda r: (r.w, r.id)):
        if all(((places[r.id] - places[j]) ** 2).sum() >= 0.15**2 for j in want):
            want.append(r.id)
    assert got == set(want)


def test_strain(spark):
    g = np.array([[0.1, 0.02, 0.0], [0.03, -0.05, 0.01], [0.0, 0.04, 0.2]])
    want = 0.5 * ((np.eye(3) + g).T @ (np.eye(3) + g) - np.eye(3))
    spacing = (0.5, 1.0, 2.0)
    rows = [(i, j, k, *map(float, g @ (np.array([i, j, k]) * spacing))) for i, j, k in itertools.product(range(4), range(3), range(3))]
    df = spark.createDataFrame(rows, "x int, y int, z int, ux double, uy double, uz double")
    found = fields.grid_strain(df, [], ("x", "y", "z"), ("ux", "uy", "uz"), spacing).collect()
    assert len(found) == len(rows)
    for r in found:
        assert all(abs(r[f"e_{'xyz'[i]}{'xyz'[j]}"] - want[i, j]) < 1e-12 for i in range(3) for j in range(i, 3))
    lone = fields.grid_strain(df.where("x = 0 and y = 0 and z = 0"), [], ("x", "y", "z"), ("ux", "uy", "uz"), spacing).first()
    assert lone.e_xx is None
    for name in ("Hex1NL", "Tet1NL", "Tet2NL"):
        geometry, order, _ = basis.element_type(name)
        places = basis.node_positions(geometry, order) + np.random.default_rng(1).uniform(-0.05, 0.05, basis.node_positions(geometry, order).shape)
        nodes = spark.createDataFrame([(k, tuple(map(float, p)), tuple(map(float, g @ p))) for k, p in enumerate(places)], f"node_id bigint, p {XYZ}, u {XYZ}")
        elements = spark.createDataFrame([(0, list(range(len(places)))), (1, [0] * len(places)), (2, [*range(len(places) - 1), 999])], "elem_id bigint, node_ids array<bigint>")
        by = {r.elem_id: r for r in fields.element_strain(elements, nodes, name, (0.2, 0.3, 0.25)).collect()}
        assert all(abs(by[0][f"e_{'xyz'[i]}{'xyz'[j]}"] - want[i, j]) < 1e-9 for i in range(3) for j in range(i, 3))
        assert by[1].e_xx is None and by[2].e_xx is None


def test_fourier(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(2, 6, 5, 8))
    df = spark.createDataFrame([(k, *map(int, p), float(v)) for k in range(2) for p, v in np.ndenumerate(a[k]) if p != (1, 2, 3)], "im int, s int, r int, c int, val double")
    a[:, 1, 2, 3] = 0
    shape = {"s": 6, "r": 5, "c": 8}
    full = np.fft.fftn(a, axes=(1, 2, 3))
    cells = df.select(F.col("im").alias("k"), "s", "r", "c", F.col("val").alias("re"), F.lit(0.0).alias("im"))
    for r in lines.fourier(cells, ["k"], shape).collect():
        assert abs(full[r.k, r.s, r.r, r.c] - complex(r.re, r.im)) < 1e-9
    near = np.zeros((6, 5, 8), bool)
    for p in np.ndindex(near.shape):
        near[p] = sum(min(k, n - k) ** 2 for k, n in zip(p, near.shape)) <= 4
    want = np.fft.ifftn(full * near, axes=(1, 2, 3)).real
    got = lines.low_pass(df, ["im"], shape, 2.0).collect()
    assert len(got) == want.size and all(abs(want[r.im, r.s, r.r, r.c] - r.val) < 1e-9 for r in got)
    moved = lines.motion(df, ["im", "s", "r"], "c", 8).collect()
    spectrum = np.abs(np.fft.fft(a, axis=3))[..., 1:].sum(3)
    assert len(moved) == 60 and all(abs(spectrum[r.im, r.s, r.r] - r.motion) < 1e-9 for r in moved)
    assert lines.low_pass(df.limit(0), ["im"], shape, 2.0).count() == 0


def test_warp(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(9, 7))
    df = spark.createDataFrame([(0, *map(int, p), float(v)) for p, v in np.ndenumerate(a)], "im int, row int, col int, val double")
    move = lambda dy, dx: df.select("im", "row", "col", F.lit(float(dy)).alias("dy"), F.lit(float(dx)).alias("dx"))
    got = {(r.row, r.col): r.val for r in lines.warp(df, move(0, 0), ["im"], 9, 7).collect()}
    assert all(abs(got[p] - v) < 1e-9 for p, v in np.ndenumerate(a))
    got = {(r.row, r.col): r.val for r in lines.warp(df, move(2, -1), ["im"], 9, 7).collect()}
    assert all(abs(got[r, c] - (a[r + 2, c - 1] if r + 2 < 9 and c >= 1 else 0)) < 1e-9 for r, c in np.ndindex(a.shape))
    # Between pixels: the surface of a cubic away from the mirrored ends.
    x = np.arange(30.0)
    line = spark.createDataFrame([(0, 0, int(k), float((k / 10) ** 3 - k)) for k in x], "im int, row int, col int, val double")
    places = line.select("im", "row", "col", F.lit(0.0).alias("dy"), F.lit(0.5).alias("dx"))
    got = {r.col: r.val for r in lines.warp(line, places, ["im"], 1, 30).collect()}
    assert all(abs(got[k] - (((k + 0.5) / 10) ** 3 - (k + 0.5))) < 1e-4 for k in range(10, 19))
    small = spark.createDataFrame([(0, r, c, float(2 * r + c)) for r in range(4) for c in range(3)], "im int, row int, col int, val double")
    grown = {(r.row, r.col): r.val for r in lines.zoomed(small, ["im"], (4, 3), 10, 7).collect()}
    assert len(grown) == 70 and abs(grown[9, 6] - 8) < 1e-9 and abs(grown[0, 0]) < 1e-9 and abs(grown[3, 3] - 3) < 1e-9


def test_loft(spark):
    n, levels = 8, 4
    ring = [("a", lv, k, (math.cos(2 * math.pi * k / n) * (4 - lv), math.sin(2 * math.pi * k / n) * (4 - lv), -float(lv))) for lv in range(levels) for k in range(n)]
    rings = spark.createDataFrame(ring, f"key string, level int, k int, p {XYZ}")
    nodes, triangles = surfaces.loft(rings, "key", n, 2)
    at = {(r.row, r.k): tuple(r.p) for r in nodes.collect()}
    assert len(at) == n * (3 * (levels - 1) + 1) + 1 and nodes.count() == len(at)
    assert all(at[3 * lv, k] == p for _, lv, k, p in ring) and abs(at[10, 0][2] + 3) < 1e-9
    edges = Counter()
    for r in triangles.collect():
        corners = [tuple(r.a), tuple(r.b), tuple(r.c)]
        assert all(c in at for c in corners)
        edges.update(zip(corners, corners[1:] + corners[:1]))
    open_edges = {e for e, m in edges.items() if edges[e[::-1]] != 1}
    assert set(edges.values()) == {1} and all(a[0] == b[0] == 0 for a, b in open_edges) and len(open_edges) == n
    _, tube = surfaces.loft(rings, "key", n, 0, closed_at_end=False)
    assert tube.count() == 2 * n * (levels - 1)


def test_contour_triangles(spark):
    """Diagonals of these contours pass through other points; copies and points in line count, too."""
    rng = random.Random(3)
    contours = [[(7, 5), (30, 0), (72, 0), (70, 35), (55, 45), (37, 55), (27, 55), (9, 50), (13, 45), (7, 45)], [(0, 0), (2, 0), (2, 0), (4, 0), (4, 4), (2, 4), (0, 4)]]
    for n in (12, 60):
        ps = [(20.0 * rng.randrange(12), float(rng.randrange(60))) for _ in range(n)]
        cx, cy = (sum(p[k] for p in ps) / n for k in (0, 1))
        contours.append(sorted(ps, key=lambda p: math.atan2(p[1] - cy, p[0] - cx)))
    rows = [(c, k, (float(x), float(y), 1.0)) for c, ps in enumerate(contours) for k, (x, y) in enumerate(ps)]
    found = surfaces.contour_triangles(spark.createDataFrame(rows, f"key int, at int, p {XYZ}"), ["key"])
    area = vec.triangle_area(F.col("a"), F.col("b"), F.col("c"))
    got = {r.key: (r.n, r.area) for r in found.groupBy("key").agg(F.count("*").alias("n"), F.sum(area).alias("area")).collect()}
    for c, ps in enumerate(contours):
        assert got[c][0] == len(ps) - 2
        assert abs(got[c][1] - abs(sum(a * y - b * x for (a, b), (x, y) in zip(ps, ps[1:] + ps[:1]))) / 2) < 1e-6


def test_contours_with_events_in_one_direction(spark, tmp_path):
    """Two events in each direction of the middle: they follow each other by their number, however the mean is rounded."""
    import datetime

    from meshlake.operators import agg
    from meshlake.plans import registry

    rng, rows, want = random.Random(8), [], {}
    for user in range(60):
        ways = list({(rng.randrange(1, 40), rng.randrange(1, 40)) for _ in range(5)})
        ways = [(a, b) for k, (a, b) in enumerate(ways) if all(a * d != b * c for c, d in ways[:k])]
        places = [(s * k * a, s * k * b) for a, b in ways for k in (1, 2) for s in (1, -1)]
        rng.shuffle(places)
        rows += [(user * 100 + k, datetime.datetime(2024, 1, 1, 0, 0, 0) + datetime.timedelta(seconds=1206 + y), user, "x", (3011 + 7 * x) / 100, "") for k, (x, y) in enumerate(places)]
        turned = sorted(range(len(places)), key=lambda k: (round(math.atan2(places[k][1] * 100, places[k][0] * 7 * 60), 12), k))
        ps = [(places[k][0] * 0.07, places[k][1] / 60) for k in turned]
        want[user] = len(ps) - 2, abs(sum(a * y - b * x for (a, b), (x, y) in zip(ps, ps[1:] + ps[:1]))) / 2
    spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.triangles, r.area) for r in registry.QUERIES["contour_triangles"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(got[u][0] == n and abs(got[u][1] - area) < 2e-6 for u, (n, area) in want.items())
    odd = spark.createDataFrame([(1, 1e17), (1, 1.0), (1, -1e17), (2, 1e30), (2, 3e30), (3, None), (4, float("inf"))], "k int, v double")
    assert {r.k: r.m for r in odd.groupBy("k").agg(agg.exact_mean("v").alias("m")).collect()} == {1: 1 / 3, 2: 2e30, 3: None, 4: float("inf")}


def test_pixels_in_polygon(spark):
    """Rows of pixels longer than a run, a whole row within a polygon, corners on pixels, places without order and pixels without a place."""
    rng = random.Random(5)
    pixels = [(k, k % 150 * 0.5, float(k // 150)) for k in range(900)] + [(900 + k, rng.uniform(0, 75), rng.choice([2.5, 3.5])) for k in range(200)]
    rng.shuffle(pixels)
    polygons = [[(-5.0, 1.5), (200.0, 1.5), (200.0, 2.5), (-5.0, 2.5)], [(1.0, 0.0), (60.0, 3.0), (40.0, 5.0), (20.0, 2.0), (10.0, 5.0)], [(rng.uniform(-5, 80), rng.uniform(-1, 6)) for _ in range(40)]]
    edges = [(n, *a, *b) for n, ps in enumerate(polygons) for a, b in zip(ps, ps[1:] + ps[:1])]
    want = set()
    for n, ps in enumerate(polygons):
        for k, x, y in pixels:
            over = sum((b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a for m, a, b, c, d in edges if m == n)
            want |= {(n, k)} if over % 2 else set()
    grid = spark.createDataFrame([*pixels, (5000, None, 2.0), (5001, 3.0, None)], "id bigint, x double, y double").repartition(3)
    frame = spark.createDataFrame(edges, "poly int, x1 double, y1 double, x2 double, y2 double")
    for found in (spatial.pixels_in_polygon(grid, frame, 2.0), spatial.points_in_polygon(grid, frame, 2.0)):
        rows = [tuple(r) for r in found.select("poly", "id").collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want
    assert {k for n, k in want if n == 0} >= set(range(300, 450))


def test_positions(spark):
    """Places of quadratic elements against numpy; none where a node or an entry is missing. Elements are gathered before they have a row for each place."""
    from meshlake.operators import mesh

    places, xi = basis.node_positions("Tet", 2), [(0.1, 0.2, 0.3), (0.0, 0.5, 0.0), (0.25, 0.25, 0.5)]
    at = {k: tuple(map(float, p)) for k, p in enumerate(np.random.default_rng(2).uniform(-9, 9, (30, 3)))}
    cells = [(0, list(range(10))), (1, list(range(29, 9, -2))), (2, [*range(9), 99]), (3, list(range(9)))]
    nodes = spark.createDataFrame(list(at.items()), f"node_id bigint, p {XYZ}")
    found = mesh.positions(spark.createDataFrame(cells, "elem_id bigint, node_ids array<bigint>"), nodes, "Tet2NL", xi)
    got = {(r.elem_id, r.k): tuple(r.p) for r in found.collect()}
    assert len(got) == 12 and all(got[e, k] == (None, None, None) for e in (2, 3) for k in range(3))
    for e, ids in cells[:2]:
        for k, place in enumerate(xi):
            want = np.array(basis.weights_at("Tet", 2, place)) @ np.array([at[i] for i in ids])
            assert np.abs(np.array(got[e, k]) - want).max() < 1e-9
    # From the top of the plan down: the places, then the aggregation, then the nodes.
    steps = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate" in line or "Aggregate" in line]
    assert "Generate" in steps[0] and "Aggregate" in steps[1] and len(places) == 10


def test_box_cells(spark):
    """A box of any size touches a few cells only."""
    df = spark.createDataFrame([(k, (0.3, 0.3, 0.3), (0.3 + 10.0**k,) * 3) for k in range(-3, 6)], f"k int, a {XYZ}, b {XYZ}")
    counts = grid.with_box_cells(df, F.col("a"), F.col("b"), 0.1).groupBy("k").count().collect()
    assert len(counts) == 9 and all(r["count"] <= 27 for r in counts)


def test_templates():
    from meshlake.operators import mesh

    for name, faces, points in (("Tet2NL", 4, 6), ("Hex1NL", 6, 9), ("Tri1NL", 3, 3)):
        found = mesh.face_template(name, 1)
        geometry, order, _ = basis.element_type(name)
        assert len(found) == faces * points and all(abs(sum(w) - 1) < 1e-9 for *_, w in found)
        places = basis.node_positions(geometry, order)
        assert all(np.abs(np.array(w) @ places - xi).max() < 1e-9 for _, _, xi, w in found)
    line = mesh.line_template("Line2NL", 3)
    assert [x for x, _ in line] == [0, 0.25, 0.5, 0.75, 1] and line[0][1] == [1, 0, 0] and line[4][1] == [0, 0, 1]
