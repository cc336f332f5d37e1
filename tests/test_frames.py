"""Photographs against each other, surfaces, imported features and octree files, against plain Python."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import crs
from terrafold.operators import frames, surface
from terrafold.plans import history
from terrafold.sources import imports, las, lod


def test_gates_take_what_is_in_range():
    g = frames.fusion_gates({"step": 3, "depth_tol": -1, "min_angle": float("nan"), "max_incidence": 60, "position": "other"})
    assert (g["step"], g["depth_tol"], g["min_angle"], g["incidence_on"], g["position"]) == (3, 0.01, 1.0, True, "mean")
    assert g["cos_incidence"] == pytest.approx(0.5)
    g = frames.fusion_gates({"step": 2.5, "remove_isolated": False, "max_incidence": 120, "position": "own"}, "close")
    assert (g["step"], g["remove_isolated"], g["incidence_on"], g["cos_incidence"], g["position"]) == (1, False, False, -1.0, "own")
    assert frames.fusion_gates(None, "close")["position"] == "own"


def test_terms_grow_with_the_block():
    assert frames.staged_terms(2, 100) == ["f", "k1"]
    assert frames.staged_terms(30, 50_000, 4, True) == ["f", "cxcy", "p", "k1", "k2", "k3", "k4"]


def rotation(rng, angle):
    axis = rng.normal(size=3)
    axis /= np.linalg.norm(axis)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + np.sin(angle) * k + (1 - np.cos(angle)) * k @ k


def test_bands_of_a_rig_follow_their_capture(spark):
    """A reference lens and two bands; some captures miss their reference, some their bands."""
    rng = np.random.default_rng(1)
    offset = {"ref": (np.eye(3), np.zeros(3)), "nir": (rotation(rng, 0.02), rng.normal(size=3) * 0.1), "red": (rotation(rng, 0.03), rng.normal(size=3) * 0.1)}
    pose, members, known = {}, [], []
    for c in range(12):
        r, t = rotation(rng, 1.0), rng.normal(size=3)
        for k, band in enumerate(offset):
            o, s = offset[band]
            pose[10 * c + k] = (o @ r, o @ t + s)
            members.append((10 * c + k, "rig", c, band, band == "ref"))
            if (c, band) not in ((9, "ref"), (10, "nir"), (11, "nir"), (11, "red")):
                known.append(10 * c + k)
    schema = "image_id long, " + ", ".join([*(f"r{k} double" for k in range(9)), *(f"t{k} double" for k in range(3))])
    cameras = spark.createDataFrame([(k, *map(float, pose[k][0].ravel()), *map(float, pose[k][1])) for k in known], schema)
    group = spark.createDataFrame(members, "image_id long, rig string, capture long, band string, reference boolean")
    offsets = frames.band_offsets(cameras, group)
    for r in offsets.collect():
        o, s = offset[r.band]
        assert np.allclose([r[f"r{k}"] for k in range(9)], o.ravel(), atol=1e-9) and np.allclose([r[f"t{k}"] for k in range(3)], s, atol=1e-9)
    got = {r.image_id: r for r in frames.complete_captures(cameras, group, offsets).collect()}
    assert set(got) == {k for k, *_ in members} - set(known)
    for k, r in got.items():
        assert np.allclose([r[f"r{j}"] for j in range(9)], pose[k][0].ravel(), atol=1e-9) and np.allclose([r[f"t{j}"] for j in range(3)], pose[k][1], atol=1e-9)


def test_seeds(spark):
    pairs = spark.createDataFrame([(1, 2, 90, True, False), (1, 3, 80, True, False), (2, 3, 70, False, False), (3, 4, 60, True, True), (5, 6, 10, True, False)], "id_a long, id_b long, inliers long, has_model boolean, excluded boolean")
    known = lambda *k: spark.createDataFrame([(x,) for x in k], "id long")
    assert [(r.id_a, r.id_b) for r in frames.rank_seeds(pairs).orderBy("rank").collect()] == [(1, 2), (1, 3)]
    assert [(r.id_a, r.id_b) for r in frames.rank_seeds(pairs, explored=known(1, 2)).collect()] == [(1, 3)]
    assert len(frames.rank_seeds(pairs, explored=known(1, 2, 3)).collect()) == 2, "not if none were left"
    tried = spark.createDataFrame([(1, 2, 90, 0.5, 0.2, 80), (1, 3, 80, 5.0, 0.9, 70), (2, 5, 60, 9.0, 0.4, 68), (3, 5, 70, 30.0, 0.1, 9)], "id_a long, id_b long, inliers long, angle double, reproj double, kept long")
    assert frames.choose_seed(tried).first()[:2] == (2, 5)


def test_control_and_stranded_blocks(spark):
    gcps = spark.createDataFrame([("a", "control", True, 1.0, 1.0, 1.0), ("b", "check", True, 1.0, 1.0, 1.0), ("c", "control", True, 1.0, 1.0, 1.0)], "name string, role string, enabled boolean, x double, y double, z double")
    marks = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("c", 1), ("b", 1), ("b", 2)], "name string, image_id long")
    placed = spark.createDataFrame([(1,), (2,)], "image_id long")
    assert [tuple(r) for r in frames.ready_control(gcps, marks, placed).collect()] == [("a", 2)]
    images = spark.range(40)
    done = spark.range(20)
    chain = [(k, k + 1, 50 + k) for k in range(20, 29)] + [(k, k + 1, 20) for k in range(35, 39)]
    inner = [(k, k + 1, 100 - k) for k in range(19)]
    pairs = spark.createDataFrame(chain + inner + [(5, 20, 30), (5, 21, 5), (8, 25, 34), (3, 36, 70)], "id_a long, id_b long, inliers long")
    got = frames.stranded_blocks(images, done, pairs, least=8, halo=5).collect()
    assert {r.image_id for r in got if r.role == "block"} == set(range(20, 30)) and {r.block for r in got} == {20}
    # 5 (35) and 8 (34) touch the block; 4 joins by 4-5 (96), then 3 and 2.
    assert {r.image_id for r in got if r.role == "halo"} == {5, 8, 4, 3, 2}


def fundamental(rng, f, size):
    r, t = rotation(rng, 0.3), rng.normal(size=3)
    tx = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]])
    k = np.array([[f * size, 0, size / 2], [0, f * size, size / 3], [0, 0, 1]])
    return np.linalg.inv(k).T @ tx @ r @ np.linalg.inv(k)


def test_focals_from_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("a", "a", 100 + k, *map(float, fundamental(rng, 1.2, 4000).ravel()), 4000.0, 4000.0, 2000.0, 4000 / 3, 2000.0, 4000 / 3) for k in range(9)]
    rows += [("b", "b", 10, *map(float, fundamental(rng, 1.2, 4000).ravel()), 4000.0, 4000.0, 2000.0, 4000 / 3, 2000.0, 4000 / 3)]
    schema = "grp_a string, grp_b string, inliers long, " + ", ".join(f"f{k} double" for k in range(9)) + ", size_a double, size_b double, cxa double, cya double, cxb double, cyb double"
    got = {r.grp: r for r in frames.focals_from_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert got["a"].own and not got["b"].own
    assert all(abs(r.s - 1.2) < 0.03 for r in got.values())


def test_planes_and_tiles(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(500_000, 500_100, (400, 2))
    z = 0.1 * xy[:, 0] - 0.2 * xy[:, 1] + 7 + rng.normal(0, 0.01, 400)
    z[:20] += 30
    p = spark.createDataFrame([(k, float(a), float(b), float(c)) for k, ((a, b), c) in enumerate(zip(xy, z))], "pid long, x double, y double, z double")
    fit = surface.fit_plane(p)
    assert abs(fit["a"] - 0.1) < 1e-3 and abs(fit["b"] + 0.2) < 1e-3 and fit["dropped"] >= 20
    assert surface.fit_plane(p.where("pid < 2")) is None and surface.plane_surface(p.where("false"), 1, 0, 0, 2, 2).count() == 0
    line = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 2.0), (2.0, 2.0, 6.0)], "x double, y double, z double")
    assert surface.fit_plane(line, robust=False)["a"] == 0 and surface.fit_plane(line, robust=False)["c"] == 3
    tiles = surface.mesh_tiles(p, 2.0, 90, overlap=2).collect()
    cells = np.floor(xy / 2).astype(int)
    owner = np.zeros(400, dtype=int)
    for t in tiles:
        core = (cells[:, 0] >= t.a0) & (cells[:, 0] < t.a1) & (cells[:, 1] >= t.b0) & (cells[:, 1] < t.b1)
        near = (cells[:, 0] >= t.a0 - t.overlap) & (cells[:, 0] < t.a1 + t.overlap) & (cells[:, 1] >= t.b0 - t.overlap) & (cells[:, 1] < t.b1 + t.overlap)
        owner += core
        assert near.sum() == t.samples <= 90
    assert (owner == 1).all() and len(tiles) > 4
    assert surface.mesh_tiles(p.where("false"), 2.0, 90).count() == 0


def test_upright_triangles_cover_nothing(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 4.0, 0.0, 0.0), (2, 4.0, 0.0, 9.0), (3, 0.0, 4.0, 8.0)], "vid long, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 1, 3), (2, 0, 1, 77)], "tid long, v0 long, v1 long, v2 long")
    got = {(r.row, r.col): r.z for r in surface.mesh_surface(v, t, 1.0, 0.0, 4.0, 4, 4).collect()}
    assert set(got) == {(r, c) for r in range(4) for c in range(4) if c <= r} and got[3, 0] == pytest.approx(1.0)


def test_radiance_model(spark):
    row = spark.createDataFrame([(1000.0, 10.0), (40.0, 10.0)], "dn double, y double")
    got = [r[0] for r in row.select(surface.radiance(F.col("dn"), F.col("y"), (1e-4, 2e-8, 3e-5), 2.0, 0.001, 16, 48.0, 3.0)).collect()]
    want = (1000 - 48) * (1e-4 / (2.0 * 0.001 * 65536)) * 3.0 / (1 + 2e-8 * 10 / 0.001 - 3e-5 * 10)
    assert got == [pytest.approx(want), 0.0]


FILES = [
    ("a/IMG_1.key", "2 16\n1.5 2.5 3 0.1 " + " ".join(["7"] * 16) + "\n4 5 6 0.2\n" + " ".join(["8"] * 16)),
    ("k.json", json.dumps([{"image": "p.jpg", "keypoints": [{"x": 1, "y": 2, "scale": 3}, {"x": 4.5, "y": 6}]}])),
    ("m.json", json.dumps([{"imageA": "p", "imageB": "q", "matches": [[0, 3], [1, 2]]}])),
    ("blocks.txt", "# pairs\nz1.jpg z2.jpg\n0 5\n1 7\n\nz1.jpg z3.jpg\n2 2\n"),
    ("points.csv", "Image A;x_a;y_a;Image_B;x_b;y_b\np;1.0;2.0;q;3.0;4.0\np;1.004;2.0;r;3.0;4.0\n"),
    ("rows.txt", "p q 3 4\np q 5 6\n"),
    ("one.txt", "10 20 1.5\n30 40 2.5\n"),
    ("named.csv", "image,x,y\nu,1,2\nv,3,4\nu,5,6\n"),
    ("bad.txt", "only words here\n"),
    ("empty.txt", "# nothing\n"),
    ("odd.txt", None),
]


def test_feature_files(spark):
    rows = imports.read_features(spark.createDataFrame(FILES, "path string, content string")).collect()
    of = lambda p: [r for r in rows if r.path == p]
    assert [(r.k, r.xa, r.ya, r.scale) for r in of("a/IMG_1.key")] == [(0, 2.5, 1.5, 3), (1, 5, 4, 6)] and of("a/IMG_1.key")[0].image_a == "IMG_1"
    assert [(r.image_a, r.xa, r.scale) for r in of("k.json")] == [("p.jpg", 1.0, 3.0), ("p.jpg", 4.5, None)]
    assert [(r.image_b, r.ka, r.kb) for r in of("m.json")] == [("q", 0, 3), ("q", 1, 2)]
    assert [(r.image_a, r.image_b, r.ka, r.kb) for r in of("blocks.txt")] == [("z1.jpg", "z2.jpg", 0, 5), ("z1.jpg", "z2.jpg", 1, 7), ("z1.jpg", "z3.jpg", 2, 2)]
    assert {r.kind for r in of("points.csv")} == {"point-matches"} and {r.kind for r in of("rows.txt")} == {"matches"}
    assert [(r.image_a, r.xa, r.scale) for r in of("one.txt")] == [("one", 10.0, 1.5), ("one", 30.0, 2.5)]
    assert [(r.image_a, r.k) for r in of("named.csv")] == [("u", 0), ("v", 0), ("u", 1)]
    assert [of(p)[0].kind for p in ("bad.txt", "empty.txt", "odd.txt")] == ["error"] * 3
    points = spark.createDataFrame([tuple(r[c] for c in ("image_a", "xa", "ya", "image_b", "xb", "yb")) for r in of("points.csv")], "image_a string, xa double, ya double, image_b string, xb double, yb double")
    keypoints, matches = imports.keypoints_of_points(points)
    assert sorted(map(tuple, keypoints.collect())) == [("p", 0, 1.0, 2.0), ("q", 0, 3.0, 4.0), ("r", 0, 3.0, 4.0)]
    assert sorted(map(tuple, matches.collect())) == [("p", "q", 0, 0), ("p", "r", 0, 0)]


XML = """<document version="2"><chunk label="C"><sensors><sensor id="0" label="cam" type="frame"><resolution width="4000" height="3000"/>
<calibration type="frame"><resolution width="4000" height="3000"/><f>3500</f><k1>-0.1</k1></calibration></sensor></sensors>
<cameras><camera id="0" label="a" sensor_id="0" enabled="true"><transform>1 0 0 0 0 1 0 0 0 0 1 0 0 0 0 1</transform><reference x="7.5" y="46" z="500" enabled="true"/></camera>
<group><camera id="1" label="b" sensor_id="0" enabled="false"/></group></cameras>
<markers><marker id="4" label="G1"><reference x="1" y="2" z="3" accuracy="0.02" enabled="1"/></marker><marker id="5"/></markers>
<frames><frame id="0"><markers><marker marker_id="4"><location camera_id="0" pinned="true" x="10.5" y="20.5"/></marker></markers></frame></frames>
<scalebars><scalebar id="0"><endpoint marker_id="4"/><endpoint marker_id="5"/><reference d="2.5" accuracy="0.001" enabled="true"/></scalebar></scalebars>
<transform><rotation>1 0 0 0 1 0 0 0 1</rotation><translation>1 2 3</translation><scale>4</scale></transform></chunk></document>"""


def test_metashape(spark):
    rows = imports.read_metashape(spark.createDataFrame([("a.xml", XML), ("b.xml", "<other/>"), ("c.xml", "<document>")], "path string, content string")).collect()
    of = lambda k: [r for r in rows if r.kind == k]
    assert json.loads(of("sensor")[0].detail) == {"f": 3500.0, "k1": -0.1, "type": "frame"} and (of("sensor")[0].x, of("sensor")[0].y) == (4000, 3000)
    assert [(r.label, r.enabled, r.z) for r in of("camera")] == [("a", True, 500.0), ("b", False, None)] and len(of("camera")[0]["values"]) == 16
    assert [(r.label, r.enabled, r.accuracy) for r in of("marker")] == [("G1", True, 0.02), ("point 5", False, None)]
    assert [(r.id, r.label, r.x, r.y) for r in of("mark")] == [("4", "0", 10.5, 20.5)]
    assert (of("scalebar")[0].x, json.loads(of("scalebar")[0].detail)) == (2.5, ["4", "5"])
    assert of("transform")[0]["values"][9:] == [1, 2, 3, 4] and sorted(r.path for r in of("error")) == ["b.xml", "c.xml"]


def copc_file(path):
    """A COPC file whose chunks are plain records: a root with two children, one below on a page of its own."""
    rng = np.random.default_rng(5)
    cubes = {(0, 0, 0, 0): (0, 16), (1, 0, 0, 0): (0, 8), (1, 1, 0, 0): (0, 8), (2, 3, 0, 0): (0, 4)}
    low = {(0, 0, 0, 0): (0, 0, 0), (1, 0, 0, 0): (0, 0, 0), (1, 1, 0, 0): (8, 0, 0), (2, 3, 0, 0): (12, 0, 0)}
    chunks, points = {}, {}
    for key, (_, edge) in cubes.items():
        xyz = rng.uniform(0, edge, (20, 3)) + low[key]
        points[key] = np.round(xyz, 3)
        chunks[key] = lod.encode14(xyz, scale=0.001, fields={"classification": np.full(20, key[0] + 2)})
    body, where = b"", {}
    head = 375 + 54 + 160
    for key, raw in chunks.items():
        shift = struct.unpack_from("<3d", raw, 155)
        records = np.frombuffer(raw[375:], dtype=las.record_type(las.read_header(raw))).copy()
        for k, c in enumerate("XYZ"):
            records[c] += int(round(shift[k] / 0.001))
        where[key] = (head + len(body), len(records.tobytes()))
        body += records.tobytes()
    entry = lambda key, at, n: struct.pack("<4iQ2i", *key, at[0], at[1], n)
    below = entry((2, 3, 0, 0), where[2, 3, 0, 0], 20)
    page = head + len(body)
    root = b"".join([entry((0, 0, 0, 0), where[0, 0, 0, 0], 20), entry((1, 0, 0, 0), where[1, 0, 0, 0], 20), entry((1, 1, 0, 0), where[1, 1, 0, 0], 20), entry((2, 3, 0, 0), (page, len(below)), -1), entry((2, 0, 0, 0), (0, 0), 0)])
    info = struct.pack("<5d2Q2d", 8, 8, 8, 8, 1.0, page + len(below), len(root), 0, 0).ljust(160, b"\0")
    top = bytearray(lod.encode14(np.zeros((0, 3)))[:375])
    struct.pack_into("<HII", top, 94, 375, head, 1)
    struct.pack_into("<Q", top, 247, 80)
    struct.pack_into("<3d3d", top, 131, 0.001, 0.001, 0.001, 0, 0, 0)
    vlr = struct.pack("<H16sHH32s", 0, b"copc", 1, 160, b"")
    path.write_bytes(bytes(top) + vlr + info + body + below + root)
    return points


def test_copc_reads_the_nodes_a_box_reaches(spark, tmp_path):
    points = copc_file(tmp_path / "a.copc.laz")
    plain = lambda chunk, n, kind, length: chunk
    every = lod.read_copc(spark, str(tmp_path / "a.copc.laz"), plain).collect()
    assert sorted((round(r.x, 3), round(r.y, 3)) for r in every) == sorted((x, y) for p in points.values() for x, y, _ in p.tolist())
    assert {r.classification - r.level for r in every} == {2}
    box = (12.5, 0, 0, 16, 4, 4)
    got = lod.read_copc(spark, str(tmp_path / "a.copc.laz"), plain, box=box).collect()
    inside = [p for own in points.values() for p in own.tolist() if all(box[k] <= p[k] <= box[3 + k] for k in range(3))]
    assert len(got) == len(inside) > 0
    info = lod.read_copc_info((tmp_path / "a.copc.laz").read_bytes())
    asked = []
    read = lambda at, n: asked.append(at) or (tmp_path / "a.copc.laz").read_bytes()[at : at + n]
    assert [n[:4] for n in lod.hierarchy(read, info, box=(0, 0, 0, 7, 7, 7))] == [(0, 0, 0, 0), (1, 0, 0, 0)] and len(asked) == 1, "the other page isn't read"
    assert max(n[0] for n in lod.hierarchy(read, info, most_level=1)) == 1
    with pytest.raises(ValueError):
        lod.read_copc_info(b"LASF".ljust(700, b"\0"))


def test_las14_round_trip_and_export(spark, tmp_path):
    rng = np.random.default_rng(6)
    xyz = rng.uniform(0, 100, (50, 3))
    raw = lod.encode14(xyz, rng.integers(0, 256, (50, 3)), fields={"classification": np.arange(50) % 40, "return_number": np.ones(50) * 2, "returns": np.ones(50) * 3, "scan_angle": np.linspace(-90, 90, 50)}, wkt='PROJCS["x"]')
    h = las.read_header(raw)
    got = las.decode(h, raw[h.offset :], 0)
    assert (h.version, h.point_format, h.count) == ((1, 4), 7, 50) and np.allclose(np.stack([got[c] for c in "xyz"], axis=1), xyz, atol=6e-4)
    assert (got["classification"] == np.arange(50) % 40).all() and (got["returns"] == 3).all() and np.allclose(got["scan_angle"], np.linspace(-90, 90, 50), atol=0.01)
    df = spark.createDataFrame([(1, k % 3, 0, 0, *map(float, p)) for k, p in enumerate(xyz)], "level int, nx long, ny long, nz long, x double, y double, z double")
    files = lod.export_nodes(df, str(tmp_path / "out")).collect()
    assert sorted(r.n for r in files) == [16, 17, 17] and all(las.read_header(open(r.path, "rb").read()).count == r.n for r in files)
    text = lod.export_nodes(df, str(tmp_path / "txt"), "xyz").collect()
    assert sum(len(open(r.path).read().splitlines()) for r in text) == 50


@pytest.mark.parametrize("above", [2000, 10])
def test_tilesets_hold_every_tile_once(spark, above):
    rng = np.random.default_rng(7)
    cells = sorted({tuple(map(int, c)) for c in rng.integers(0, 8, (60, 3))})
    nodes = spark.createDataFrame([(3, *c, *(float(v) for k in c for v in (k, k + 1)), 0.5) for c in cells], "level int, nx long, ny long, nz long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double, error double")
    bounds = lod.tile_bounds(nodes, 12)
    files = {r.name: json.loads(r.json) for r in lod.tileset(bounds, every=2, above=above).collect()}
    seen = []

    def walk(tile, parent):
        b = np.array(tile["boundingVolume"]["box"])
        low, high = b[:3] - b[[3, 7, 11]], b[:3] + b[[3, 7, 11]]
        assert (low >= parent[0] - 1e-9).all() and (high <= parent[1] + 1e-9).all()
        uri = tile.get("content", {}).get("uri", "")
        if uri.endswith(".json"):
            return walk(files["tiles/" + uri.rsplit("/", 1)[-1]]["root"], (low, high))
        if uri:
            seen.append(uri.rsplit("/", 1)[-1])
        for child in tile.get("children", []):
            walk(child, (low, high))

    walk(files["tileset.json"]["root"], (np.full(3, -1e9), np.full(3, 1e9)))
    assert sorted(seen) == sorted(f"3-{x}-{y}-{z}.glb" for x, y, z in cells)
    assert (len(files) > 1) == (above == 10)
    assert files["tileset.json"]["geometricError"] >= 2 * files["tileset.json"]["root"]["geometricError"]


def test_annotations(spark):
    rows = [("p", "http://s/p", 400, 300, i, j, i / 2, j / 2, None if (i, j) == (0, 0) else 7.0 + i, 46.0 + j) for i in range(3) for j in range(3)]
    rows += [("q", "http://s/q", 400, 300, i, 0, i / 2, 0.0, 7.0 + i, 46.0) for i in range(3)]
    df = spark.createDataFrame(rows, "image_id string, uri string, width long, height long, i int, j int, u double, v double, lon double, lat double")
    got = lod.annotations(df, F.col("lon"), F.col("lat"), 3).collect()
    assert [r.image_id for r in got] == ["p"]
    a = json.loads(got[0].json)
    assert len(a["body"]["features"]) == 8 and a["target"]["source"] == {"id": "http://s/p", "type": "ImageService3", "width": 400, "height": 300}
    assert a["target"]["selector"]["value"] == '<svg width="400" height="300"><polygon points="200,0 0,150 0,300 200,300 400,300 400,150 400,0" /></svg>'
    assert a["body"]["features"][0]["properties"]["resourceCoords"] == [200.0, 0.0]


UTM = 'PROJCS["UTM",GEOGCS["WGS 84",DATUM["D",SPHEROID["W",6378137,298.257223563]],AUTHORITY["EPSG","4326"]],PROJECTION["Transverse_Mercator"],UNIT["metre",1],AUTHORITY["EPSG","32632"]]'


def test_systems():
    assert crs.metres_per_unit(UTM) == 1 and crs.wkt_epsg(UTM) == 32632 and not crs.is_geographic(UTM)
    feet = 'COMPD_CS["x",PROJCS["p",GEOGCS["g"],UNIT["US survey foot",0.304800609601219]],VERT_CS["v",UNIT["m",1]]]'
    assert crs.metres_per_unit(feet) == pytest.approx(1200 / 3937) and crs.unit_label(feet) == "US-ft" and crs.wkt_epsg(feet) is None
    two = 'PROJCRS["n",BASEGEOGCRS["b"],CONVERSION["c"],CS[Cartesian,2],AXIS["e",east,LENGTHUNIT["foot",0.3048]],ID["EPSG",2222]]'
    assert crs.metres_per_unit(two) == pytest.approx(0.3048) and crs.wkt_epsg(two) == 2222
    assert crs.metres_per_unit("+proj=utm +zone=32") == 1 and crs.metres_per_unit("+proj=lcc +units=us-ft") == pytest.approx(1200 / 3937)
    assert crs.metres_per_unit("+proj=lcc +to_meter=0.5") == 0.5 and crs.to_units(3, "+proj=lcc +to_meter=0.5") == 6
    assert [crs.metres_per_unit(x) for x in ("+proj=longlat", 'GEOGCS["g"]', 'LOCAL_CS["l"]', None, "", "PROJCS[", "+proj=lcc +units=parsec")] == [None] * 7
    assert crs.unit_label("+proj=longlat") == "CRS units"


def test_history_and_log(spark):
    h = history.EditHistory(entries=3, size=100, limits={"file": 1})
    for k in range(5):
        h.record(history.Edit(f"e{k}", f"v{k}", f"v{k + 1}", 10))
    assert [e.label for e in h.undo] == ["e2", "e3", "e4"]
    assert h.take_back() == "v4" and h.take_back() == "v3" and h.repeat() == "v4"
    h.record(history.Edit("new", "v4", "w", 95))
    assert h.redo == [] and h.repeat() is None and [e.label for e in h.undo] == ["new"], "beyond the bytes only the last step stays"
    h.record(history.Edit("f1", "w", "w1", 1, "file"))
    h.record(history.Edit("f2", "w1", "w2", 1, "file"))
    assert [e.label for e in h.undo] == ["new", "f2"] and h.versions() == {"v4", "w", "w1", "w2"}
    h.keep(lambda e: e.kind == "file")
    assert len(h.undo) == 1 and history.EditHistory().take_back() is None
    lines = spark.createDataFrame([(1.0, "sparse", "info", "a"), (2.0, "Sparse", "error", "b"), (3.0, "who", "loud", "c"), (4.0, None, "info", "d")], "t double, source string, level string, message string")
    digest = history.log_digest(lines)
    assert sorted((r.source, r.level, r.n) for r in digest.collect()) == [("Sparse", "error", 1), ("Sparse", "info", 1), ("System", "info", 2)]
    assert history.digest_markdown(digest).splitlines()[2:] == ["| Sparse | error | 1 |", "| Sparse | info | 1 |", "| System | info | 2 |"]
    assert math.isfinite(len(history.LOG_SOURCES))


def test_guided_matches(spark):
    rng = np.random.default_rng(9)
    x = np.column_stack((rng.uniform(0, 20, (60, 2)), rng.uniform(0, 2, 60)))
    d = rng.normal(size=(60, 4))
    down = [1.0, 0, 0, 0, -1, 0, 0, 0, -1]
    photos, keypoints, known, places = [], [], [], {}
    for k, (cx, cy, h) in enumerate([(8.0, 8.0, 30.0), (12.0, 11.0, 28.0)]):
        photos.append((k, *map(float, down), -cx, cy, h, 500.0, 500.0, 200.0, 200.0, 400, 400, cx - 60, cy - 60, cx + 60, cy + 60))
        depth = h - x[:, 2]
        u, v = 500 * (x[:, 0] - cx) / depth + 200, 500 * (cy - x[:, 1]) / depth + 200
        for j in range(60):
            if 0 <= u[j] < 400 and 0 <= v[j] < 400:
                places[j, k] = j
                keypoints.append((k, j, float(u[j] + rng.normal(0, 0.5)), float(v[j] + rng.normal(0, 0.5)), [float(c) for c in d[j] + rng.normal(0, 0.01, 4)]))
                keypoints.append((k, 1000 + j, float(u[j] + 3), float(v[j]), [float(c) for c in d[j] + 5]))
                if j % 4 == 0 and k == 0:
                    known.append((j, k, j))
    schema = "image_id long, " + ", ".join(f"{c} {'int' if c in ('width', 'height') else 'double'}" for c in surface.PHOTO[1:])
    points = spark.createDataFrame([(j, *map(float, x[j]), d[j].tolist()) for j in range(60)], "pt long, x double, y double, z double, d array<double>")
    keys = spark.createDataFrame(keypoints, "image_id long, kp long, u double, v double, d array<double>")
    held = spark.createDataFrame(known, "pt long, image_id long, kp long")
    got = {(r.pt, r.image_id): r.kp for r in frames.guided_matches(points, spark.createDataFrame(photos, schema), keys, held).collect()}
    assert got == {k: v for k, v in places.items() if (k[0], k[1], v) not in set(known)}
