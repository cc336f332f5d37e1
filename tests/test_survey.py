import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geom
from terrafold.operators import mesh, survey


def test_core_extent_leaves_stragglers_out(spark):
    rng = np.random.default_rng(0)
    p = np.concatenate((rng.random((20_000, 2)) * 100, rng.random((15, 2)) * 5000 + 1000))
    df = spark.createDataFrame([tuple(map(float, x)) for x in p], "x double, y double")
    e = survey.core_extent(df)
    assert -5 < e["x_min"] < 5 and 95 < e["x_max"] < 115 and 95 < e["y_max"] < 115
    assert survey.core_extent(df.where("false")) == {}


def test_footprint_of_a_nadir_camera(spark):
    r = [F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0, 0, 0, -1)]
    c = (F.lit(50.0), F.lit(60.0), F.lit(110.0))
    k = tuple(F.lit(v) for v in (1000.0, 1000.0, 500.0, 400.0))
    got = spark.range(1).select(survey.footprint(r, c, k, F.lit(1000.0), F.lit(800.0), F.lit(10.0)).alias("f")).first().f
    assert [(p.x, p.y) for p in got] == [(0, 100), (100, 100), (100, 20), (0, 20)]


def test_mesh_distance_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    v, t, p = rng.random((30, 3)) * 10, rng.integers(0, 30, (25, 3)), rng.random((80, 3)) * 10
    vertices = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(v)], "vid long, x double, y double, z double")
    triangles = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(t)], "tid long, v0 long, v1 long, v2 long")
    points = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "pid long, x double, y double, z double")
    got = {r.pid: r.distance for r in survey.mesh_distance(points, mesh.corners(vertices, triangles), 2.0).collect()}
    u = np.linspace(0, 1, 60)
    a, b = np.meshgrid(u, u)
    a, b = a[a + b <= 1], b[a + b <= 1]
    for k in range(80):
        dense = min(np.linalg.norm(v[i] + a[:, None] * (v[j] - v[i]) + b[:, None] * (v[m] - v[i]) - p[k], axis=1).min() for i, j, m in t)
        if dense < 1.9:
            assert got[k] == pytest.approx(dense, abs=0.12) and got[k] <= dense + 1e-9
        elif dense > 2.2:
            assert got[k] is None


def test_gains_even_out(spark):
    true = np.array([0.2, -0.1, 0.0, 0.3])
    pairs = [(0, 1), (1, 2), (2, 3), (0, 3), (0, 2)]
    df = spark.createDataFrame([(i, j, 500.0, float(true[i] - true[j])) for i, j in pairs], "i int, j int, n double, d double")
    g = survey.fit_gains(df, 4, prior=1e-6)
    got = np.array([g[k] for k in range(4)])
    assert np.allclose(got - got[0], -(true - true[0]), atol=1e-4)


def test_measures(spark):
    df = spark.createDataFrame([([(0.0, 0.0), (3.0, 0.0), (3.0, 4.0)],), ([(1e6, 1e6)],)], "p array<struct<x:double,y:double>>")
    assert [tuple(r) for r in df.select(survey.polyline("p"), survey.shoelace("p")).collect()] == [(7.0, 6.0), (0.0, 0.0)]


def test_control_and_pair_statistics(spark):
    gcps = spark.createDataFrame([("a", "control", True, 1.0, 1.0, 0.0), ("b", "control", True, 1.0, None, 0.0), ("c", "check", True, 1.0, 1.0, 1.0), ("d", "control", None, 1.0, 1.0, 1.0)], "name string, role string, enabled boolean, x double, y double, z double")
    marks = spark.createDataFrame([("a", 1), ("a", 2), ("d", 1), ("d", 1)], "name string, image_id int")
    assert tuple(survey.control_readiness(gcps, marks).first()) == (1, 1, 1, 1)
    pairs = spark.createDataFrame([(1, 2, "done", False, True, 30), (1, 3, "done", True, True, 9), (2, 3, "error", None, None, 0), (2, 4, "done", None, False, 50)], "id_a int, id_b int, status string, weak boolean, enabled boolean, inliers int")
    used = spark.createDataFrame([(1, 2, 5)], "id_a int, id_b int, shared int")
    r = survey.pair_stats(pairs, used).first()
    assert (r.verified, r.weak, r.excluded, r.error, r.used, r.least, r.most) == (3, 1, 1, 1, 1, 30, 30)
    assert [x.inliers for x in survey.weakest(pairs, 2).collect()] == [9, 30]


def test_views_and_agreement(spark):
    rays = [(p, i, float(np.sin(a)), 0.0, float(np.cos(a))) for p in range(10) for i, a in ((1, 0.0), (2, 0.1), (3, 0.005))]
    r = spark.createDataFrame(rays, "pt int, image_id int, dx double, dy double, dz double")
    got = {(x.image_id, x.source): x.shared for x in survey.source_views(r.select("pt", "image_id"), r).collect()}
    assert got == {(1, 2): 10, (2, 1): 10, (3, 2): 10, (2, 3): 10}
    tracks = spark.createDataFrame([(i, k, k) for i in (1, 2) for k in range(8)] + [(3, k, k + 100) for k in range(8)], "image_id int, kp int, pt int")
    m = spark.createDataFrame([(1, b, k, k, 0.5) for b in (2, 3) for k in range(8)], "id_a int, id_b int, kp_a int, kp_b int, error double")
    assert {x.id_b: (x.together, x.split, x.verdict) for x in survey.pair_agreement(m, tracks).collect()} == {2: (8, 0, "agrees"), 3: (0, 8, "conflicts")}


def test_accuracies(spark):
    r = spark.range(1).select(survey.one_sigma(F.lit(1.96), "95").alias("a"), survey.one_sigma(F.lit(2.0), "hrms").alias("b"), survey.mahalanobis([F.lit(1.0), F.lit(2.0), F.lit(3.0)], [F.lit(1.0), F.lit(2.0), F.lit(3.0)], F.lit(0.0)).alias("m")).first()
    assert (r.a, r.b, r.m) == (pytest.approx(1.0), pytest.approx(2**0.5), pytest.approx(3**0.5))


def test_enclosed_gaps_are_filled_between_their_surroundings(spark):
    rows = [(r, c, float(r + c)) for r in range(8) for c in range(8) if not (3 <= r <= 4 and 3 <= c <= 4) and (r, c) != (0, 7)]
    got = {(r.row, r.col): r for r in survey.fill_enclosed(spark.createDataFrame(rows, "row long, col long, z double")).collect()}
    assert (0, 7) not in got and len(got) == 63
    for r in (3, 4):
        for c in (3, 4):
            assert got[r, c].filled == 1 and 3 <= got[r, c].z <= 11


def test_warp_and_selection(spark):
    cells = spark.createDataFrame([(r, c, float(c)) for r in range(10) for c in range(10)], "row long, col long, z double")
    target = spark.createDataFrame([(0, k, 2.0 * k + 4, 10.0) for k in range(3)], "row long, col long, x double, y double")
    got = survey.warp(cells, target, lambda x, y: (x / 2, y / 2), 1.0, 0.0, 10.0).orderBy("col").collect()
    assert [r.z for r in got] == [1.5, 2.5, 3.5]
    p = spark.createDataFrame([(1, 0.5, 0.5, 0.0), (2, 5.0, 0.5, 0.0)], "pid long, x double, y double, z double")
    eye = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    inside = survey.screen_select(p, eye, [[(0, 0), (1, 0), (1, 1), (0, 1)]])
    assert [r.pid for r in inside.collect()] == [1]
    assert sorted((r.pid, r.classification) for r in survey.classify_selection(p, inside, 6).collect()) == [(1, 6), (2, 0)]
    r = survey.import_transform(p, 0.5, True).where("pid = 2").first()
    assert (r.x, r.y, r.z) == (2.5, 0.0, 0.25)
    assert geom.A == 6378137.0


def test_profile(spark):
    images = spark.createDataFrame([(4000, 3000, 1.0, 0.0), (4000, 3000, 1.0, 9.0)], "width int, height int, lon double, t double")
    gcps = spark.createDataFrame([("control",), ("check",)], "role string")
    r = survey.profile_dataset(images, gcps).first()
    assert (r.images, r.megapixels, r.positioned, r.seconds, r.controls, r.checks, r.kind) == (2, 12.0, 1.0, 9.0, 1, 1, "aerial")
