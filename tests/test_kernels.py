import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geom
from terrafold.operators import kernels, mesh
from terrafold.plans import workflow


@pytest.fixture
def cube(spark):
    v = [(k, float(k & 1), float(k >> 1 & 1), float(k >> 2 & 1)) for k in range(8)]
    quads = [(0, 2, 3, 1), (4, 5, 7, 6), (0, 1, 5, 4), (2, 6, 7, 3), (0, 4, 6, 2), (1, 3, 7, 5)]
    t = [x for a, b, c, d in quads for x in ((a, b, c), (a, c, d))]
    return spark.createDataFrame(v, "vid long, x double, y double, z double"), spark.createDataFrame([(k, *x) for k, x in enumerate(t)], "tid long, v0 long, v1 long, v2 long")


def test_cube(spark, cube):
    v, t = cube
    m = mesh.measure(v, t).first()
    assert (m.triangles, m.area, m.volume) == (12, pytest.approx(6), pytest.approx(1))
    r = mesh.topology(t).first()
    assert (r.edges, r.boundary, r.non_manifold, r.watertight) == (18, 0, 0, True)
    assert mesh.face_adjacency(t).count() == 18
    assert mesh.topology(t.where("tid > 0")).first().boundary == 3
    assert {x.component for x in mesh.triangle_components(t).collect()} == {0}
    far = t.unionByName(spark.createDataFrame([(99, 20, 21, 22)], t.schema))
    assert mesh.drop_small(far, 2).count() == 12
    assert mesh.compact(v, t.where("tid < 2")).count() == 4
    assert mesh.crop(v, t, {"z": 0.5}, {}).count() == 2


def test_sampling_is_even_and_repeats(cube):
    v, t = cube
    a = mesh.sample(v, t, 500).toPandas()
    assert len(a) == pytest.approx(3000, rel=0.01)
    assert ((a[["x", "y", "z"]].min(axis=1) < 1e-9) | (a[["x", "y", "z"]].max(axis=1) > 1 - 1e-9)).all()
    assert np.allclose(a[["x", "y", "z"]].mean(), 0.5, atol=0.03)
    b = mesh.sample(v.repartition(3), t.repartition(5), 500).toPandas()
    key = ["tid", "x", "y", "z"]
    assert a.sort_values(key).reset_index(drop=True).equals(b.sort_values(key).reset_index(drop=True))


def test_weld_number_and_obj(spark, cube):
    v, t = cube
    twice = v.unionByName(v.select((F.col("vid") + 100).alias("vid"), "x", "y", "z"))
    both = t.unionByName(t.select((F.col("tid") + 100).alias("tid"), *[(F.col(f"v{k}") + 100).alias(f"v{k}") for k in range(3)]))
    w, u = mesh.weld(twice, both, 0.01)
    assert w.count() == 8 and u.count() == 24 and u.agg(F.max("v1")).first()[0] < 8
    n, f = mesh.numbered(v.withColumn("vid", F.col("vid") * 7 + 3), t.select("tid", *[(F.col(f"v{k}") * 7 + 3).alias(f"v{k}") for k in range(3)]))
    assert sorted(r.vid for r in n.collect()) == list(range(1, 9))
    lines = [r.value for r in mesh.to_obj(n, f).collect()]
    assert len(lines) == 20 and lines[0].startswith("v ") and lines[-1].startswith("f ")
    assert mesh.measure(n, f).first().volume == pytest.approx(1)


def test_smoothing_keeps_a_closed_shape_about(cube):
    v, t = cube
    out = mesh.smooth(v, t, rounds=2).toPandas()
    assert len(out) == 8 and np.allclose(out[["x", "y", "z"]].mean(), 0.5, atol=0.1)


def test_normals_of_a_slope(spark):
    rng = np.random.default_rng(0)
    p = rng.random((300, 2)) * 10
    df = spark.createDataFrame([(k, float(x), float(y), float(0.5 * x)) for k, (x, y) in enumerate(p)], "pid long, x double, y double, z double")
    n = kernels.normals(df, 2.0).toPandas()
    want = np.array([-0.5, 0, 1]) / np.sqrt(1.25)
    assert np.allclose(n[["nx", "ny", "nz"]], want, atol=1e-6) and n.planarity.max() < 1e-9


def test_undistort_inverts_distort(spark):
    k = {"k1": -0.1, "k2": 0.02, "k3": 0.001, "p1": 1e-3, "p2": -5e-4}
    df = spark.createDataFrame([(x / 10, y / 10) for x in range(-6, 7) for y in range(-5, 6)], "x double, y double")
    bent = df.select("x", "y", *[c.alias(n) for c, n in zip(geom.distort(F.col("x"), F.col("y"), **k), "uv")])
    r = bent.select("x", "y", kernels.undistort(F.col("u"), F.col("v"), **k).alias("s")).select("x", "y", "s.x", "s.y").toPandas()
    assert np.allclose(r.iloc[:, :2], r.iloc[:, 2:], atol=1e-10)


def scene():
    rng = np.random.default_rng(1)
    points = rng.random((60, 3)) * [10, 10, 3]
    cameras = []
    for x in (2.0, 5.0, 8.0):
        r = np.diag([1.0, -1.0, -1.0])
        cameras.append((r, -r @ np.array([x, 5.0, 20.0])))
    return points, cameras


def pixels(points, r, t):
    c = points @ r.T + t
    return c[:, :2] / c[:, 2:] * 1000 + [640, 480]


def test_triangulation_recovers_points(spark):
    points, cameras = scene()
    rows = [(k, float(u), float(v), r.ravel().tolist(), t.tolist(), 1000.0, 1000.0, 640.0, 480.0) for r, t in cameras for k, (u, v) in enumerate(pixels(points, r, t))]
    rows.append((999, 1.0, 1.0, cameras[0][0].ravel().tolist(), cameras[0][1].tolist(), 1000.0, 1000.0, 640.0, 480.0))
    df = spark.createDataFrame(rows, "pt long, u double, v double, R array<double>, t array<double>, fx double, fy double, cx double, cy double")
    out = kernels.triangulate(df).orderBy("pt").toPandas()
    assert np.allclose(out[["x", "y", "z"]].iloc[:60].astype(float), points, atol=1e-6) and out.x.iloc[60] is None or np.isnan(out.x.iloc[60])


def test_ransac_tells_outliers(spark):
    points, cameras = scene()
    cameras[1] = (cameras[1][0] @ np.array([[0.98, -0.199, 0], [0.199, 0.98, 0], [0, 0, 1]]), cameras[1][1] + [0, 0.5, 1.0])
    a, b = (pixels(points, *c) for c in cameras[:2])
    b = b.copy()
    b[:15] += np.random.default_rng(2).uniform(60, 200, (15, 2))
    df = spark.createDataFrame([(1, 2, *map(float, p), *map(float, q)) for p, q in zip(a, b)] + [(3, 4, 1.0, 1.0, 2.0, 2.0)], "id_a long, id_b long, xa double, ya double, xb double, yb double")
    got = {(r.id_a, r.id_b): r for r in kernels.verify_matches(df, 1.0).collect()}
    assert 45 <= got[1, 2].inliers <= 50 and got[3, 4].F is None


def test_footprints(spark):
    square = lambda x, y, s=10.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [(1, square(0.0, 0.0)), (2, square(5.0, 0.0)), (3, square(8.0, 8.0)), (4, square(100.0, 0.0)), (5, square(2.0, 2.0, 2.0))]
    df = spark.createDataFrame(rows, "id long, ring array<struct<x:double,y:double>>")
    got = {(r.id_a, r.id_b): r.overlap for r in kernels.footprint_pairs(df, 7.0).collect()}
    assert got == {(1, 2): pytest.approx(0.5), (1, 5): pytest.approx(1.0)}


def test_cloth_finds_the_ground_in_any_blocks(spark):
    rng = np.random.default_rng(3)
    xy = rng.random((4000, 2)) * 40
    z = 0.02 * xy[:, 0] + np.where((abs(xy - 20) < 3).all(axis=1), 6.0, 0.0)
    df = spark.createDataFrame([(k, *map(float, p), float(h)) for k, (p, h) in enumerate(zip(xy, z))], "pid long, x double, y double, z double")
    for block in (64, 16):
        got = kernels.cloth_ground(df, 1.0, block=block).toPandas().set_index("pid").classification
        roof = np.flatnonzero((abs(xy - 20) < 2.5).all(axis=1))
        assert (got.loc[roof] == 1).all() and (got.drop(roof) == 2).mean() > 0.95


def test_recipes_round_trip_and_preflight():
    steps = workflow.parse_run("run dem gsd=2 how=min fill radius=900 terrain")
    assert steps[0].settings == {"gsd": 2.0, "how": "min"} and steps[1].settings == {"radius": 64}
    steps[1].gates.append(("filled", "<=", 0.5))
    assert workflow.parse_recipe(workflow.recipe(steps)) == steps
    assert workflow.preflight(steps, {"points"}) == [] and workflow.preflight(steps[1:], set()) == ["step 1 (fill) needs dem", "step 2 (terrain) needs dem"][:1]
    assert workflow.changed(steps[1]) == {"radius": 64}
    for bad in ("walk dem", "run nothing", "run gsd=1", "run dem colour=3"):
        with pytest.raises(ValueError):
            workflow.parse_run(bad)


def test_execute_stops_at_a_gate(spark):
    points = spark.createDataFrame([(k, float(k % 7), float(k // 7), float(k)) for k in range(49)], "pid long, x double, y double, z double")
    steps = workflow.parse_recipe("dem gsd=1\n  gate cells >= 49\nfill\n  gate cells >= 1000\nterrain\n")
    state, verdicts = workflow.execute(spark, steps, {"points": points}, workflow.runners(), lambda s, m: float(s["dem"].count()))
    assert [v for _, _, v in verdicts] == ["pass", "fail"] and "terrain" not in state
