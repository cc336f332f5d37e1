import json
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from terrafold.operators import rules
from terrafold.sources import interop


def test_database(spark, tmp_path):
    path = str(tmp_path / "d.db")
    con = sqlite3.connect(path)
    con.executescript("CREATE TABLE images(image_id, name, camera_id); CREATE TABLE keypoints(image_id, rows, cols, data); CREATE TABLE matches(pair_id, rows, cols, data)")
    con.execute("INSERT INTO images VALUES (1, 'a.jpg', 1)")
    con.execute("INSERT INTO keypoints VALUES (1, 2, 6, ?)", (np.array([[1, 2, 3, 0, 0, 3], [4, 5, 0, -2, 2, 0]], dtype="<f4").tobytes(),))
    con.execute("INSERT INTO matches VALUES (?, 2, 2, ?)", (3 * 2147483647 + 9, np.array([[0, 1], [5, 6]], dtype="<u4").tobytes()))
    con.commit()
    con.close()
    got = interop.read_database(spark, path)
    k = got["keypoints"].orderBy("kp").collect()
    assert (k[0].scale, k[0].angle) == (3, 0) and k[1].scale == 2 and abs(k[1].angle - np.pi / 2) < 1e-9
    assert sorted(map(tuple, got["matches"].collect())) == [(3, 9, 0, 1), (3, 9, 5, 6)]


def test_other_models():
    cameras, points = interop.parse_nvm("NVM_V3\n\n1\na b.jpg 900 1 0 0 0 1 2 3 0.1 0\n\n1\n1 2 3 10 20 30 1 0 7 5.5 -6.5\n")
    assert cameras[0][0] == "a b.jpg" and cameras[0][1] == 900 and points[0][6] == [(0, 7, 5.5, -6.5)]
    cameras, points = interop.parse_bundler("# Bundle file v0.3\n1 1\n900 0 0\n1 0 0\n0 1 0\n0 0 1\n1 2 3\n4 5 6\n1 2 3\n1 0 7 5.5 6.5\n")
    assert cameras[0][4] == [1, 2, 3] and points[0][:6] == (4, 5, 6, 1, 2, 3) and points[0][6] == [(0, 7, 5.5, 6.5)]
    f = interop.parse_transforms(json.dumps({"fl_x": 5, "cx": 1, "frames": [{"file_path": "a", "transform_matrix": [[1]]}, {"file_path": "b", "fl_x": 7, "transform_matrix": [[2]]}]}))
    assert [x[1] for x in f] == [5, 7]


def test_lines_and_metadata(spark):
    df = spark.createDataFrame([(4, 1.0, 0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 1, "a.jpg", [(1.0, 2.0, None), (3.0, 4.0, 9)])], "image_id int, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id int, name string, marks array<struct<x:double,y:double,point_id:bigint>>")
    lines = [r.value for r in interop.colmap_image_lines(df).orderBy("line").collect()]
    assert lines == ["4 1.0 0.0 0.0 0.0 1.0 2.0 3.0 1 a.jpg", "1.5 2.5 -1 3.5 4.5 9"]
    names = "image_id focal exposure taken subsec lat lat_ref lon lon_ref alt alt_ref yaw pitch roll".split()
    row = ("1", "88/10", "1/200", "2024:01:01 00:00:01", "5", "10.5", "S", "20.25", "E", "99", "1", "5", "-90", "x")
    r = interop.normalize_metadata(spark.createDataFrame([row], ", ".join(f"{n} string" for n in names))).first()
    assert (r.focal, r.exposure, r.lat, r.lon, r.alt, r.yaw, r.roll) == (8.8, 0.005, -10.5, 20.25, -99.0, 5.0, None) and r.t % 60 == 1.5


def test_more_rules(spark):
    tiles = [(1, float(x), float(x), True) for x in range(0, 100, 8)] + [(2, 5.0, 5.0, True)] * 20 + [(3, float(x), float(x), x < 16) for x in range(0, 100, 2)]
    df = spark.createDataFrame(tiles, "tile int, x double, y double, inlier boolean")
    assert [r.tile for r in rules.accept_tile(df, 100.0).collect()] == [1]
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 30.0, 0.0, 0.0)], "pt int, x double, y double, z double")
    c = spark.createDataFrame([(7, 0.0, 0.0, 10.0), (8, 30.0, 5.0, 10.0)], "image_id int, x double, y double, z double")
    assert sorted(map(tuple, rules.visibility(p, c, 20.0).collect())) == [(1, 7), (2, 8)]
    a = rules.dem_anchors(spark.createDataFrame([(1, 5.0, 3), (2, 9.0, 2), (3, 7.0, 5)], "pt int, z double, views int"), spark.createDataFrame([(1, 4.5), (3, 7.25), (2, 1.0)], "id int, z double"))
    assert [(r.pt, r.dz) for r in a.collect()] == [(3, -0.25), (1, 0.5)]
    assert rules.layout([{"a": "int", "b": "int"}, {"a": "double", "c": "int"}]) == {"a": "double", "b": "int", "c": "int"}
    assert rules.format_problem(5, 5) is None and "later" in rules.format_problem(6, 5) and rules.format_problem(None, 5)
    assert rules.memory_plan(1000, 100, 30_000)["tiles"] == 4
    k = spark.createDataFrame([(1, i, float(i % 2), 0.0, float(-i)) for i in range(10)], "image_id int, kp int, x double, y double, response double")
    assert sorted(r.kp for r in rules.spread_subset(k, 2, 2.0, 2.0, 4).collect()) == [0, 1, 2, 3]
    assert rules.scaled_px(4.0, spark.createDataFrame([(2.0,), (3.0,), (2.0,)], "scale double")) == 8.0
    assert spark.range(1).select(F.lit(1)).count() == 1
