"""Numerical solves on made scenes."""

import numpy as np
import pytest

from terrafold.operators import match, solve, surface
from terrafold.sources import formats


def scene(seed=0, cameras=8, points=120):
    rng = np.random.default_rng(seed)
    x = rng.uniform(-1, 1, (points, 3)) + [0, 0, 6]
    r, t = solve.turn(rng.normal(0, 0.1, (cameras, 3))), rng.normal(0, 0.4, (cameras, 3))
    r[0], t[0] = np.eye(3), 0
    lens = np.tile([800.0, 810, 320, 240], (cameras, 1))
    cam, pt = np.repeat(np.arange(cameras), points), np.tile(np.arange(points), cameras)
    keep = rng.random(len(cam)) < 0.7
    cam, pt = cam[keep], pt[keep]
    uv = solve.residuals(r[cam], t[cam], lens[cam], x[pt], np.zeros((len(cam), 2)))[0]
    return rng, x, r, t, lens, cam, pt, uv


def test_derivatives():
    _, x, r, t, lens, cam, pt, uv = scene()
    e, a, b, _ = solve.residuals(r[cam], t[cam], lens[cam], x[pt], uv)
    h = 1e-6
    for d in range(3):
        w = np.eye(3)[d] * h
        assert np.abs((solve.residuals(solve.turn(w[None])[0] @ r[cam], t[cam], lens[cam], x[pt], uv)[0] - e) / h - a[:, :, d]).max() < 1e-2
        assert np.abs((solve.residuals(r[cam], t[cam] + w, lens[cam], x[pt], uv)[0] - e) / h - a[:, :, 3 + d]).max() < 1e-2
        assert np.abs((solve.residuals(r[cam], t[cam], lens[cam], x[pt] + w, uv)[0] - e) / h - b[:, :, d]).max() < 1e-2


def test_bundle_adjustment_finds_the_scene_again(spark):
    rng, x, r, t, lens, cam, pt, uv = scene()
    m = len(r)
    r2 = solve.turn(np.concatenate((np.zeros((1, 3)), rng.normal(0, 0.02, (m - 1, 3))))) @ r
    t2, x2 = t + np.concatenate((np.zeros((1, 3)), rng.normal(0, 0.03, (m - 1, 3)))), x + rng.normal(0, 0.05, x.shape)
    cost = solve.bundle(r2, t2, lens, x2, cam, pt, uv)[3]
    assert cost[-1] < 1e-6 and cost == sorted(cost, reverse=True)
    cameras = spark.createDataFrame([(1, k, *map(float, r2[k].ravel()), *map(float, t2[k]), *map(float, lens[k])) for k in range(m)], "block int, image_id long, " + ", ".join(f"{c} double" for c in (*solve.POSE, *solve.LENS)))
    points = spark.createDataFrame([(1, k, *map(float, p)) for k, p in enumerate(x2)], "block int, pt long, x double, y double, z double")
    seen = spark.createDataFrame([(1, int(c), int(p), *map(float, q)) for c, p, q in zip(cam, pt, uv)], "block int, image_id long, pt long, u double, v double")
    got = solve.bundle_adjust(seen, cameras, points).collect()
    poses = {g.id: np.array(g["values"]) for g in got if g.kind == "camera"}
    places = {g.id: np.array(g["values"]) for g in got if g.kind == "point"}
    e = solve.residuals(np.array([poses[c][:9].reshape(3, 3) for c in cam]), np.array([poses[c][9:] for c in cam]), lens[cam], np.array([places[p] for p in pt]), uv)[0]
    assert np.abs(e).max() < 1e-3 and np.allclose(poses[0][:9].reshape(3, 3), np.eye(3))
    with pytest.raises(ValueError):
        solve.bundle_adjust(seen, cameras, points, most=10)


def test_photographs_are_placed_among_false_matches(spark):
    rng, x, r, t, lens, cam, pt, uv = scene(3)
    rows, bad = [], 0
    for c in range(1, 5):
        own = cam == c
        noisy = uv[own] + rng.normal(0, 0.3, (own.sum(), 2))
        wrong = rng.random(own.sum()) < 0.25
        noisy[wrong] += rng.normal(0, 100, (wrong.sum(), 2))
        bad += wrong.sum()
        rows += [(c, int(p), *map(float, q)) for p, q in zip(pt[own], noisy)]
    rows += [(9, k, 1.0 * k, 2.0) for k in range(5)] + [(8, k, *map(float, rng.uniform(0, 600, 2))) for k in range(30)]
    lenses = spark.createDataFrame([(k, 800.0, 810.0, 320.0, 240.0) for k in range(10)], "image_id long, fx double, fy double, cx double, cy double")
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "pt long, x double, y double, z double")
    got = {g.image_id: g for g in solve.register_images(spark.createDataFrame(rows, "image_id long, pt long, u double, v double"), points, lenses).collect()}
    assert set(got) == {1, 2, 3, 4} and sum(g.matched - g.inliers for g in got.values()) == pytest.approx(bad, abs=4)
    for k, g in got.items():
        assert np.allclose([g[f"r{j}"] for j in range(9)], r[k].ravel(), atol=5e-3) and np.allclose([g[f"t{j}"] for j in range(3)], t[k], atol=3e-2)


def two_views(rng, n=80, flat=False):
    x = rng.uniform(-1, 1, (n, 3)) + [0, 0, 5]
    if flat:
        x[:, 2] = 5 + 0.2 * x[:, 0]
    r, t = solve.turn(np.array([[0.05, -0.1, 0.02]]))[0], np.array([0.6, 0.1, 0.05])
    k = np.array([[700, 0, 320], [0, 700, 240], [0, 0, 1.0]])
    a, b = x @ k.T, (x @ r.T + t) @ k.T
    e = solve.cross(t[None])[0] @ r
    return a[:, :2] / a[:, 2:], b[:, :2] / b[:, 2:], np.linalg.inv(k).T @ e @ np.linalg.inv(k), k, r, t / np.linalg.norm(t)


def test_motion_of_a_pair(spark):
    rng = np.random.default_rng(1)
    a, b, f, k, r, t = two_views(rng)
    got = solve.relative_pose(f, k, k, a, b)
    assert np.allclose(got[0], r, atol=1e-6) and np.allclose(got[1], t, atol=1e-6) and got[2].all() and 3 < got[3] < 12
    matches = spark.createDataFrame([(1, 2, *map(float, p), *map(float, q)) for p, q in zip(a, b)], "id_a long, id_b long, xa double, ya double, xb double, yb double")
    models = spark.createDataFrame([(1, 2, f.ravel().tolist()), (1, 3, None)], "id_a long, id_b long, F array<double>")
    lenses = spark.createDataFrame([(j, 700.0, 700.0, 320.0, 240.0) for j in (1, 2, 3)], "image_id long, fx double, fy double, cx double, cy double")
    g = solve.relative_poses(matches, models, lenses).collect()
    assert len(g) == 1 and g[0].kept == 80 and np.allclose([g[0][f"r{j}"] for j in range(9)], r.ravel(), atol=1e-6)


def test_planar_pairs_are_told(spark):
    rng = np.random.default_rng(2)
    rows = []
    for pair, flat in ((2, True), (3, False)):
        a, b, *_ = two_views(rng, flat=flat)
        rows += [(1, pair, *map(float, p), *map(float, q)) for p, q in zip(a, b)]
    rows += [(1, 4, 0.0, 0.0, 1.0, 1.0)]
    got = {g.id_b: g for g in solve.planar_share(spark.createDataFrame(rows, "id_a long, id_b long, xa double, ya double, xb double, yb double"), 1.0).collect()}
    assert got[2].planar == 80 and got[3].planar < 60 and got[2].spread > 0.5 and (got[4].planar, got[4].spread) == (0, 1 / 64)


def test_depth_by_plane_sweep_and_its_prior(spark):
    rng = np.random.default_rng(4)
    big = rng.normal(size=(120, 160))
    for _ in range(2):
        big = (big + np.roll(big, 1, 0) + np.roll(big, 1, 1) + np.roll(big, -1, 0) + np.roll(big, -1, 1)) / 5
    row = lambda k, shift: (k, 80, 60, big[20:80, 30 + shift : 110 + shift].astype("<f4").tobytes(), *np.eye(3).ravel().tolist(), -0.05 * shift, 0.0, 0.0, 100.0, 100.0, 40.0, 30.0, 2.0, 10.0)
    schema = "image_id long, width long, height long, grey binary, " + ", ".join(f"{c} double" for c in (*solve.POSE, *solve.LENS)) + ", near double, far double"
    pictures = spark.createDataFrame([row(1, 0), row(2, 4), row(3, -4)], schema)
    pairs = spark.createDataFrame([(1, 2, 1), (1, 3, 2), (2, 1, 1)], "image_id long, source long, rank int")
    got = {g.image_id: g for g in solve.depth_maps(pictures, pairs, planes=33).collect()}
    assert set(got) == {1, 2}
    depth = np.frombuffer(got[1].depth, dtype="<f4").reshape(60, 80)
    assert np.median(depth) == pytest.approx(5, abs=1e-3) and (np.abs(depth - 5) < 0.4).mean() > 0.9
    maps = spark.createDataFrame([(1, 80, 60, bytes(got[1].depth), bytes(got[1].cost), 100.0, 100.0, 40.0, 30.0)], "image_id long, width long, height long, depth binary, cost binary, fx double, fy double, cx double, cy double")
    prior = np.frombuffer(solve.planar_priors(maps).first().depth, dtype="<f4").reshape(60, 80)
    assert np.median(prior[prior > 0]) == pytest.approx(5, abs=0.05) and (prior > 0).mean() > 0.5
    none = solve.planar_prior(np.zeros((9, 9)), np.zeros((9, 9)), np.eye(3))
    assert not none[0].any()


def test_triangulation_leaves_circles_empty():
    rng = np.random.default_rng(5)
    p = np.concatenate((rng.uniform(0, 100, (150, 2)), [[50.0, 50.0], [50.0, 50.0]]))
    tri = solve.delaunay(p)
    for a, b, c in tri:
        m = np.linalg.solve(2 * np.array([p[b] - p[a], p[c] - p[a]]), [p[b] @ p[b] - p[a] @ p[a], p[c] @ p[c] - p[a] @ p[a]])
        rest = np.setdiff1d(np.arange(len(p)), [a, b, c])
        assert (np.linalg.norm(p[rest] - m, axis=1) >= np.linalg.norm(p[a] - m) - 1e-6).all()
    grid = np.stack(np.meshgrid(np.arange(6), np.arange(6)), -1).reshape(-1, 2).astype(float)
    assert len(solve.delaunay(grid)) == 50


def test_blending_keeps_one_picture_and_smooths_a_seam(spark):
    rng = np.random.default_rng(6)
    a = rng.uniform(0, 255, (48, 64, 3))
    assert np.abs(solve.blend([a], [np.ones((48, 64))]) - a).max() < 1e-9
    left = np.zeros((48, 64), dtype="<f4")
    left[:, :32] = 1
    one, two = np.full((48, 64, 3), 50, dtype=np.uint8), np.full((48, 64, 3), 200, dtype=np.uint8)
    rows = [(7, 1, 64, 48, one.tobytes(), left.tobytes()), (7, 2, 64, 48, two.tobytes(), (1 - left).tobytes()), (8, 1, 64, 48, one.tobytes(), left.tobytes())]
    got = {g.tile: np.frombuffer(g.rgb, dtype=np.uint8).reshape(48, 64, 3) for g in solve.blend_tiles(spark.createDataFrame(rows, "tile int, image_id long, width long, height long, rgb binary, weight binary")).collect()}
    line = got[7][24, :, 0].astype(int)
    assert (np.diff(line) >= 0).all() and line[0] < 60 and line[-1] > 190 and 100 < line[31] < 150
    assert (got[8][:, :32] == 50).all() and (got[8][:, 32:] == 0).all()


def test_decimated_meshes_and_views_of_faces(spark):
    n = 12
    vertices = spark.createDataFrame([(r * n + c, c * 1.0, r * 1.0, 0.0) for r in range(n) for c in range(n)], "vid long, x double, y double, z double")
    tri = [(2 * (r * n + c) + k, *t) for r in range(n - 1) for c in range(n - 1) for k, t in enumerate(((r * n + c, r * n + c + 1, (r + 1) * n + c), (r * n + c + 1, (r + 1) * n + c + 1, (r + 1) * n + c)))]
    triangles = spark.createDataFrame(tri, "tid long, v0 long, v1 long, v2 long")
    v, t = solve.decimate(vertices, triangles, 3.0)
    assert v.count() == 16 and t.count() == 18 and t.select("v0").subtract(v.select("vid")).count() == 0
    down = [1.0, 0, 0, 0, -1, 0, 0, 0, -1]
    photo = lambda k, x, y, h: (k, *map(float, down), -x, y, h, 100.0, 100.0, 200.0, 200.0, 400, 400, x - 50, y - 50, x + 50, y + 50)
    schema = "image_id long, " + ", ".join(f"{c} double" for c in (*solve.POSE, *solve.LENS)) + ", width int, height int, " + ", ".join(f"{c} double" for c in ("x0", "y0", "x1", "y1"))
    photos = spark.createDataFrame([photo(1, 5.0, 5.0, 20.0), photo(2, 0.0, 0.0, 5.0), photo(3, 500.0, 0.0, 5.0)], schema)
    assert [c.split()[0] for c in schema.split(", ")] == surface.PHOTO
    got = {g.tid: g for g in solve.face_views(vertices, triangles, photos).collect()}
    assert len(got) == len(tri) and got[0].image_id == 2 and got[0].area == pytest.approx(200) and got[max(got)].image_id == 1


def test_seeds_lie_apart_and_empty_words_move(spark):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(c, 0.01, (40, 3)) for c in ([0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9])])
    seeds = match.spread_seeds(v, 4)
    assert len({tuple(np.rint(s / 9).astype(int)) for s in seeds}) == 4
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "id long, v array<double>")
    words = np.array([r.c for r in match.train_codebook(df, 4, 4, seeding="spread").collect()])
    assert len({tuple(np.rint(w / 9).astype(int)) for w in words}) == 4
    # The four smallest ids lie together: words left empty move to the far groups.
    same = spark.createDataFrame([(k, [0.0, 0.0]) for k in range(10)] + [(50, [7.0, 7.0]), (51, [7.0, 7.1])], "id long, v array<double>")
    words = sorted(tuple(r.c) for r in match.train_codebook(same, 3, 3).collect())
    assert words[0] == (0.0, 0.0) and words[-1][0] == 7.0
    assert match.train_codebook(df.where("false"), 3, 2).count() == 0


def test_binary_models(spark):
    import struct

    cameras = struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 7, 1, 4000, 3000, 3500.0, 3501.0, 2000.0, 1500.0)
    images = struct.pack("<Q", 1) + struct.pack("<I7dI", 3, 1, 0, 0, 0, 1, 2, 3, 7) + b"a.jpg\0" + struct.pack("<Q", 2) + struct.pack("<ddq", 1.5, 2.5, 9) + struct.pack("<ddq", 3.5, 4.5, -1)
    points = struct.pack("<Q", 1) + struct.pack("<Q3d3BdQ", 9, 1, 2, 3, 10, 20, 30, 0.5, 2) + struct.pack("<4i", 3, 0, 4, 1)
    read = lambda raw, kind: formats.read_colmap_binary(spark.createDataFrame([("p", raw)], "path string, content binary"), kind).collect()
    assert read(cameras, "cameras")[0].params == [3500.0, 3501.0, 2000.0, 1500.0]
    r = read(images, "images")[0]
    assert (r.image_id, r.name, r.tz, r.camera_id) == (3, "a.jpg", 3.0, 7) and [tuple(p) for p in r.points] == [(1.5, 2.5, 9), (3.5, 4.5, None)]
    assert read(points, "points3D")[0].track == [3, 0, 4, 1]
    with pytest.raises(ValueError):
        formats.colmap_binary(cameras, "other")


def test_targets_are_found_to_parts_of_a_pixel(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k in range(6):
        cx, cy, a = *rng.uniform(35, 45, 2), rng.uniform(0, np.pi)
        fine = np.arange(0, 80, 0.25) + 0.125 - 0.5
        x, y = np.meshgrid(fine, fine)
        u, v = (x - cx) * np.cos(a) + (y - cy) * np.sin(a), -(x - cx) * np.sin(a) + (y - cy) * np.cos(a)
        mat = np.where((np.abs(u) < 15) & (np.abs(v) < 15), np.where(u * v > 0, 230, 20), 120)
        chip = mat.reshape(80, 4, 80, 4).mean(axis=(1, 3)) + rng.normal(0, 2, (80, 80))
        want[k] = cx + 100, cy + 200
        rows.append((k, f"g{k}", 100, 200, 80, 80, np.clip(chip, 0, 255).astype(np.uint8).tobytes(), 138.0, 242.0))
    rows.append((9, "none", 0, 0, 80, 80, rng.integers(100, 110, 6400).astype(np.uint8).tobytes(), 40.0, 40.0))
    chips = spark.createDataFrame(rows, "image_id int, name string, x0 int, y0 int, width int, height int, grey binary, gu double, gv double")
    got = {r.image_id: (r.u, r.v) for r in solve.find_targets(chips).collect()}
    assert set(got) == set(want) and all(np.hypot(got[k][0] - want[k][0], got[k][1] - want[k][1]) < 0.15 for k in want)
    assert solve.checker_corner(np.zeros((5, 5)), (2, 2)) is None
