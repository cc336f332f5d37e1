"""Operators without SQL against plain Python, and the rules that any input must keep."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import geom
from terrafold.operators import cloud, evaluate, graph, match, raster, series


@pytest.fixture
def lattice(spark):
    rows = [(i * 36 + j * 6 + k, float(i), float(j), float(k)) for i in range(6) for j in range(6) for k in range(6)]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double")


def test_filters_keep_a_lattice(lattice):
    assert cloud.remove_isolated(lattice, 1.0).count() == 216
    assert cloud.outlier_filter(lattice, 1.5, std_ratio=3.0).count() == 216
    assert cloud.voxel_first(lattice, 1.0).count() == 216
    assert cloud.voxel_mean(lattice, 2.0).count() == 27


def test_lonely_point_goes(spark, lattice):
    far = lattice.unionByName(spark.createDataFrame([(999, 50.0, 50.0, 50.0)], lattice.schema))
    assert cloud.remove_isolated(far, 1.0).count() == 216
    assert cloud.outlier_filter(far, 1.5, std_ratio=3.0).count() == 216


def test_octree_places_every_point_once(lattice):
    out = cloud.octree_levels(lattice, (0.0, 0.0, 0.0), 6.0, 2, 10).toPandas()
    assert len(out) == 216 and out.pid.is_unique
    assert out.groupby(["level", "nx", "ny", "nz"]).size().max() <= 10


def test_transform_turns_normals(spark):
    p = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 0.0, 0.0, 1.0)], "pid long, x double, y double, z double, nx double, ny double, nz double")
    r = cloud.transform(p, [[1, 0, 0, 5], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 1]]).first()
    assert (r.x, r.y, r.z) == (6.0, -3.0, 2.0)
    assert np.allclose((r.nx, r.ny, r.nz), (0, -1, 0))


def test_empty_inputs(spark, lattice):
    none = lattice.where("false")
    assert cloud.voxel_mean(none, 1.0).count() == 0
    assert cloud.merge_clouds([none, lattice], 1.0).count() == 216
    assert raster.rasterize(none, 1.0, 0.0, 6.0, 6, 6).count() == 0
    assert raster.fill_nodata(raster.rasterize(none, 1.0, 0.0, 6.0, 6, 6)).count() == 0


def test_codebook_is_lloyd(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, v array<double>")
    got = np.array([r.c for r in match.train_codebook(df, 5, 3).orderBy("word").collect()])
    words = v[:5].copy()
    for _ in range(3):
        own = ((v[:, None] - words[None]) ** 2).sum(-1).argmin(1)
        words = np.array([v[own == k].mean(0) if (own == k).any() else words[k] for k in range(5)])
    assert np.allclose(got, words)


def test_keyframes_match_the_greedy_rule(spark):
    rng = np.random.default_rng(1)
    travel, sharp = np.cumsum(rng.random(80)), rng.random(80)
    df = spark.createDataFrame([(1, k, float(k), float(travel[k]), float(sharp[k])) for k in range(80)], "seq long, id long, t double, travel double, sharpness double")
    got = sorted(r.id for r in series.select_keyframes(df, 3.0).collect())
    assert got == series.pick_keyframes(travel, sharp, 3.0)
    few = series.select_keyframes(df, 0.5, 10).count()
    assert 0 < few <= 10


def test_components_and_bridges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (7, 8)], "id_a long, id_b long")
    nodes = spark.createDataFrame([(k,) for k in range(1, 10)], "id long")
    got = {r.id: r.component for r in graph.components(nodes, e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7, 8: 7, 9: 9}
    assert sorted(map(tuple, graph.bridges(e).collect())) == [(3, 4), (4, 5), (7, 8)]


def test_similarity_is_recovered(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(30, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    b = 2.5 * a @ q.T + [1, 2, 3]
    df = spark.createDataFrame([(*map(float, x), *map(float, y)) for x, y in zip(a, b)], "sx double, sy double, sz double, tx double, ty double, tz double")
    fit = evaluate.fit_similarity(df)
    assert fit["scale"] == pytest.approx(2.5) and np.allclose(fit["rotation"], q) and np.allclose(fit["translation"], [1, 2, 3])


def test_icp_recovers_a_small_shift(spark):
    rng = np.random.default_rng(4)
    a = rng.random((150, 3)) * 10
    ref = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(a)], "pid long, x double, y double, z double")
    src = ref.select("pid", (F.col("x") + 0.1).alias("x"), (F.col("y") - 0.05).alias("y"), "z")
    fit = evaluate.icp(src, ref, 2.0, rounds=5, trim=1.0)
    assert np.allclose(fit["translation"], [-0.1, 0.05, 0], atol=1e-6)


def test_nuth_kaab_recovers_a_shift(spark):
    rng = np.random.default_rng(5)
    slope, aspect = rng.uniform(8, 40, 400), rng.uniform(0, 360, 400)
    dh = np.tan(np.radians(slope)) * (0.3 * np.cos(np.radians(aspect)) + 0.2 * np.sin(np.radians(aspect)))
    df = spark.createDataFrame([tuple(map(float, x)) for x in zip(dh, slope, aspect)], "dh double, slope double, aspect double")
    fit = evaluate.nuth_kaab(df)
    assert fit["north"] == pytest.approx(0.3, abs=0.02) and fit["east"] == pytest.approx(0.2, abs=0.02)


def test_projection_round_trips(spark):
    df = spark.createDataFrame([(lon, lat) for lon in (-170.0, 3.2, 10.7, 121.5) for lat in (-60.0, 0.5, 47.0, 63.0)], "lon double, lat double")
    x, y, z = geom.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.lit(120.0))
    lon, lat, h = geom.ecef_to_geodetic(x, y, z)
    tx, ty = geom.lonlat_to_tile(F.col("lon"), F.col("lat"), 14)
    blon, blat = geom.tile_to_lonlat(tx, ty, 14)
    r = df.select("lon", "lat", lon.alias("a"), lat.alias("b"), h.alias("h"), blon.alias("c"), blat.alias("d")).toPandas()
    assert np.allclose(r.lon, r.a) and np.allclose(r.lat, r.b, atol=1e-9) and np.allclose(r.h, 120, atol=1e-4)
    assert np.allclose(r.lon, r.c) and np.allclose(r.lat, r.d)


def snyder_utm(lon, lat, zone):
    """The classical series (Snyder 1987, 8-9 to 8-13): another derivation of the same map."""
    a, e2, k0 = geom.A, geom.E2, 0.9996
    ep2 = e2 / (1 - e2)
    phi, away = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    n, t, c = a / np.sqrt(1 - e2 * np.sin(phi) ** 2), np.tan(phi) ** 2, ep2 * np.cos(phi) ** 2
    x = away * np.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * np.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * np.sin(4 * phi) - 35 * e2**3 / 3072 * np.sin(6 * phi))
    east = k0 * n * (x + (1 - t + c) * x**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * x**5 / 120)
    north = k0 * (m + n * np.tan(phi) * (x * x / 2 + (5 - t + 9 * c + 4 * c * c) * x**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * x**6 / 720))
    return east + 500000, north + (10000000 if lat < 0 else 0)


def test_utm_and_vincenty(spark):
    places = [(2.2945, 48.8584, 31), (-72.1, -33.4, 18), (140.9, 0.01, 54), (11.9, 60.5, 32)]
    df = spark.createDataFrame(places, "lon double, lat double, zone int")
    e, n = geom.utm(F.col("lon"), F.col("lat"), F.col("zone"))
    for r in df.select("*", e.alias("e"), n.alias("n")).collect():
        assert (r.e, r.n) == pytest.approx(snyder_utm(r.lon, r.lat, r.zone), abs=0.01)
    # Flinders Peak to Buninyong, a published test line (GRS80 and WGS84 agree to a millimetre).
    line = spark.createDataFrame([(144.4248679444, -37.9510334167, 143.9264955278, -37.6528211389)], "a double, b double, c double, d double")
    d = line.select(geom.vincenty(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("d")).first().d
    assert d == pytest.approx(54972.271, abs=0.01)


def test_rotations_round_trip(spark):
    df = spark.createDataFrame([(10.0, -20.0, 130.0), (0.0, 0.0, 0.0), (-170.0, 45.0, -5.0)], "o double, p double, k double")
    m = geom.opk_matrix(F.col("o"), F.col("p"), F.col("k"))
    o, p, k = geom.opk_from_matrix(m)
    q = geom.rotation_of(*geom.quaternion(m))
    r = df.select("o", "p", "k", o.alias("o2"), p.alias("p2"), k.alias("k2"), *[(a - b).alias(f"d{i}") for i, (a, b) in enumerate(zip(m, q))]).toPandas()
    assert np.allclose(r[["o", "p", "k"]], r[["o2", "p2", "k2"]])
    assert np.allclose(r[[f"d{i}" for i in range(9)]], 0, atol=1e-12)
