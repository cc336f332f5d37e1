import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.operators import select
from terrafold.sources import formats


@pytest.mark.parametrize("binary", [True, False])
def test_ply_round_trip(spark, tmp_path, binary):
    rng = np.random.default_rng(0)
    xyz, colour, faces = rng.random((500, 3)), rng.integers(0, 256, (500, 3)), rng.integers(0, 500, (20, 3))
    path = str(tmp_path / "a.ply")
    with open(path, "wb") as f:
        f.write(formats.ply_bytes(xyz, colour, faces, binary))
    spark.dataSource.register(formats.PlySource)
    df = spark.read.format("ply").option("records", "200").load(path)
    got = df.orderBy("vid").toPandas()
    assert np.allclose(got[["x", "y", "z"]], xyz) and [r["red"] for r in got.extra] == colour[:, 0].tolist()
    assert formats.ply_faces(path) == [tuple(map(int, f)) for f in faces]


def test_sniffing():
    cases = {b"LASF\0": "las", b"1 2 3\n4 5 6\n7 8 9\n": "xyz", b'{"type":"FeatureCollection"}': "geojson", b"ncols 4\n": "asciigrid", b"# Image list with": "colmap", b"name,x,y\na,1,2\n": "table", b"II*\0": "tiff", b"": "unknown"}
    for head, kind in cases.items():
        assert formats.sniff(head)[0] == kind
    assert formats.raster_kind(1, "float32", -9999, 0, 900) == "dem" and formats.raster_kind(3, "uint8", None, 0, 255) == "ortho"
    assert formats.raster_kind(5, "uint16", None, 0, 1) == "multispectral"
    assert formats.pyramid(1000, 700) == [(0, 1000, 700), (1, 500, 350), (2, 250, 175)]
    assert formats.tiles_for(1, 0, 0, 1025, 10) == [(0, 0), (1, 0)]


def test_colmap_text(spark, tmp_path):
    p = tmp_path / "images.txt"
    p.write_text("# Image list\n1 1 0 0 0 1 2 3 7 a b.jpg\n1.5 2.5 -1 3 4 9\n2 0.5 0.5 0.5 0.5 0 0 0 7 c.jpg\n\n")
    images = formats.colmap_images(formats.numbered_lines(spark, str(p))).where("image_id is not null")
    got = {r.image_id: r for r in images.collect()}
    assert got[1].name == "a b.jpg" and (got[1].tx, got[1].ty, got[1].tz, got[2].qw) == (1, 2, 3, 0.5)
    marks = [tuple(r) for r in formats.colmap_observations(images.where("image_id = 1")).collect()]
    assert marks == [(1, 0, 1.5, 2.5, None), (1, 1, 3.0, 4.0, 9)]
    q = spark.createDataFrame([("# c",), ("5 1 2 3 10 20 30 0.5 1 0 2 4",)], "value string")
    r = formats.colmap_points(q).first()
    assert (r.point_id, r.z, r.g, r.track) == (5, 3.0, 20, [1, 0, 2, 4])


def test_geotiff_holds_its_values():
    a = np.arange(12, dtype=float).reshape(3, 4)
    raw = formats.geotiff_bytes(a, 0.5, 100.0, 200.0, 32631, nodata=-9999)
    assert raw[:4] == b"II*\0" and (np.frombuffer(raw[-48:], "<f4") == a.ravel()).all()
    n = int.from_bytes(raw[8:10], "little")
    tags = [int.from_bytes(raw[10 + 12 * k : 12 + 12 * k], "little") for k in range(n)]
    assert tags == sorted(tags) and {256, 257, 33550, 33922, 34735, 42113} <= set(tags)
    assert 34735 not in [int.from_bytes(formats.geotiff_bytes(a, 1, 0, 0)[10 + 12 * k : 12 + 12 * k], "little") for k in range(13)]


def test_archives_are_bounded():
    def made(names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, "x" * 10)
        return b.getvalue()

    assert formats.read_archive(made(["a/b.txt", "c.bin"]), lambda n: n.endswith(".txt")) == {"a/b.txt": b"x" * 10}
    for bad, options in ((["../a"], {}), (["a", "b"], {"entries": 1}), (["a", "b"], {"size": 15})):
        with pytest.raises(ValueError):
            formats.read_archive(made(bad), lambda n: True, **options)


def test_suppression_is_greedy_and_spares_siblings(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 9.0), (1, 2, 1, 1.0, 0.0, 1.0, 8.0), (1, 3, 0, 10.5, 0.0, 1.0, 7.0), (1, 4, 1, 0.0, 0.0, 1.0, 6.0), (1, 5, 1, 30.0, 0.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "image_id int, kp int, tile int, x double, y double, scale double, response double")
    assert sorted(r.kp for r in select.suppress(df, 2.0).collect()) == [1, 3, 4, 5]


def test_overlap_reduction_keeps_coverage(spark):
    rng = np.random.default_rng(0)
    rows = [(p, i) for p in range(60) for i in rng.choice(12, 6, replace=False).tolist()]
    df = spark.createDataFrame(rows, "pt int, image_id int")
    gone = {r.image_id for r in select.reduce_overlap(df, 3).collect()}
    left = {p: len({i for q, i in rows if q == p} - gone) for p in range(60)}
    assert gone and min(left.values()) >= 3


def test_masks_projects_and_sensors(spark):
    images = spark.createDataFrame([(1, "u1", "a/IMG1.jpg"), (2, "u2", "IMG2.JPG")], "ord int, key string, name string")
    files = spark.createDataFrame([(1, "img1_mask.png"), (2, "IMG2.JPG.png"), (3, "IMG2.JPG"), (4, "other.png")], "ord int, file string")
    assert {r.key: r.file for r in select.mask_files(files, images).collect()} == {"u1": "img1_mask.png", "u2": "IMG2.JPG.png"}
    t = spark.createDataFrame([("t1", "a.jpg", 5, 10, 10), ("t2", "b.jpg", 6, 10, 10)], "uuid string, name string, size int, width int, height int")
    s = spark.createDataFrame([("s1", "a.jpg", 5, 10, 10), ("t2", "z.jpg", 1, 1, 1), ("s3", "b.jpg", 9, 9, 9)], t.schema)
    got = {r.uuid: (r.matched, r.label) for r in select.merge_projects(t, s).collect()}
    assert got == {"s1": ("t1", "a.jpg"), "t2": ("t2", "z.jpg"), "s3": (None, "b.jpg (2)")}
    cams = spark.createDataFrame([(1, "DJI", "X", 8.8, 4000, 3000), (2, "dji ", "x", 8.8, 4000, 3000), (3, None, None, None, None, None), (4, "DJI", "X", 24.0, 4000, 3000)], "image_id int, make string, model string, focal double, width int, height int")
    assert {r.image_id: r.sensor for r in select.sensor_groups(cams).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}


def test_enclosed_gaps(spark):
    full = {(r, c) for r in range(6) for c in range(6)}
    gaps = {(2, 2), (2, 3), (0, 5), (1, 5), (4, 0)}
    df = spark.createDataFrame([(r, c, 1.0) for r, c in full - gaps], "row long, col long, z double")
    assert {(r.row, r.col) for r in select.enclosed(df).collect()} == {(2, 2), (2, 3)}


def test_depth_fusion_and_speckles(spark):
    rows = [(m, float(x) + 0.1 * m, 0.5, 0.5, 10.0) for m in range(3) for x in range(5)] + [(0, 9.5, 0.5, 0.5, 10.0), (1, 3.3, 0.5, 0.5, 99.0)]
    df = spark.createDataFrame(rows, "map_id int, x double, y double, z double, depth double")
    out = select.fuse_depths(df, 1.0, 2).toPandas()
    assert len(out) == 5 and (out.views.max(), out.views.min()) == (3, 2) or (out.views == 3).all()
    px = spark.createDataFrame([(0, u, v, 10.0 if (u, v) != (2, 2) else 50.0) for u in range(5) for v in range(5)], "map_id int, u int, v int, depth double")
    kept = {(r.u, r.v) for r in select.speckle_filter(px).collect()}
    assert (2, 2) not in kept and (1, 1) in kept


def test_affine_fit_is_recovered(spark):
    rng = np.random.default_rng(0)
    p = rng.random((20, 2))
    rows = [(1, float(x), float(y), float(2 * x - 0.5 * y + 3), float(0.25 * x + 1.5 * y - 1)) for x, y in p]
    r = select.affine_fit(spark.createDataFrame(rows, "g int, X double, Y double, px double, py double"), ["g"]).first()
    assert np.allclose([r.a, r.b, r.c, r.d, r.e, r.f], [2, -0.5, 3, 0.25, 1.5, -1]) and r.rms < 1e-6


def test_other_rules(spark):
    pairs = spark.createDataFrame([(1, 2, 50, 1.0), (1, 3, 40, 1.0), (2, 3, 30, 1.0), (1, 4, 20, 30.0), (2, 4, 10, 30.0)], "id_a int, id_b int, inliers int, median_px double")
    assert {r.image_id for r in select.registration_outliers(pairs).where("flagged").collect()} == {4}
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2), (1, 1, 2), (2, 2, 3)], "row long, col long, label int")
    got = {(r.row, r.col): r.label for r in select.majority(cells).collect()}
    assert got[(0, 0)] == 1 and got[(2, 2)] == 2
    nodes = spark.createDataFrame([(0, 10, 4.0), (1, 30, 2.0), (2, 100, 1.0)], "level int, count int, spacing double")
    assert {r.level for r in select.extract_levels(nodes, 45).collect()} == {0, 1}
    tiles = spark.createDataFrame([(2, x, y, float(x)) for x in range(4) for y in range(4)], "z int, x int, y int, value double")
    assert select.tile_pyramid(tiles, 2).where("z = 0").first().value == 1.5
    r = spark.range(1).select(select.unregistered_reason(F.lit(5), F.lit(0), F.lit(1)).alias("r")).first().r
    assert r == "no matches"
