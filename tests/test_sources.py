import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.functions import color, text
from terrafold.sources import las
from terrafold.sources import text as X
from terrafold.streaming import events, journal


@pytest.fixture
def cloud(tmp_path):
    rng = np.random.default_rng(0)
    xyz = np.round(rng.random((1000, 3)) * 100 + [4e5, 5e6, 100], 3)
    colour = rng.integers(0, 256, (1000, 3))
    fields = {"intensity": rng.integers(0, 65536, 1000), "classification": rng.integers(0, 19, 1000)}
    path = os.path.join(tmp_path, "a.las")
    with open(path, "wb") as f:
        f.write(las.encode(xyz, colour, fields=fields))
    return path, xyz, colour, fields


def test_las_round_trip_by_record_ranges(spark, cloud):
    path, xyz, colour, fields = cloud
    spark.dataSource.register(las.LasSource)
    df = spark.read.format("las").option("records", "300").load(path)
    assert df.rdd.getNumPartitions() == 4
    got = df.orderBy("pid").toPandas()
    assert got.pid.tolist() == list(range(1000))
    assert np.allclose(got[["x", "y", "z"]], xyz, atol=5e-4)
    assert (got[["r", "g", "b"]].to_numpy() == colour).all()
    assert (got.intensity == fields["intensity"]).all() and (got.classification == fields["classification"]).all()
    assert (got.return_number == 1).all() and (got.returns == 1).all() and got.gps_time.isna().all()
    assert las.points_by_return(df).first().n == 1000


def test_las_extra_bytes():
    head = bytearray(las.encode(np.zeros((0, 3))))
    struct.pack_into("<HII", head, 94, 227, 227 + 54 + 192, 1)
    struct.pack_into("<BHI", head, 104, 0, 24, 2)
    vlr = bytearray(54 + 192)
    struct.pack_into("<2x16sHH", vlr, 0, b"LASF_Spec", 4, 192)
    vlr[54 + 2 : 54 + 4] = bytes([9, 8])
    vlr[54 + 4 : 54 + 10] = b"height"
    struct.pack_into("<d", vlr, 54 + 112, 0.5)
    h = las.read_header(bytes(head + vlr))
    assert h.extra == [("height", "<f4", 0.5, 0.0)] and h.count == 2
    record = struct.pack("<3iHBBbBHf", 1, 2, 3, 7, 9, 2, 0, 0, 0, 4.0)
    assert las.decode(h, record * 2, 0)["extra"]["height"].tolist() == [2.0, 2.0]


def test_las_refuses_what_it_cannot_read(cloud):
    with open(cloud[0], "rb") as f:
        raw = bytearray(f.read(227))
    with pytest.raises(ValueError):
        las.read_header(b"NOPE" + bytes(raw[4:]))
    raw[104] |= 0x80
    with pytest.raises(ValueError):
        las.read_header(bytes(raw))


def test_las_plan(spark):
    p = spark.createDataFrame([(1, 5.0, 70000.0, None), (2, 6.5, 3.0, None)], "intensity int, user_data double, classification double, point_source int")
    assert las.plan_fields(p, p.columns) == {"intensity": "standard", "user_data": "extra", "classification": "extra", "point_source": "dropped"}


def test_mapping():
    assert X.guess_mapping(["Name", "Easting", "Northing", "Alt"]) == {"name": 0, "x": 1, "y": 2, "z": 3}
    assert X.guess_mapping(["label", "lon", "lat", "x", "y"]) == {"name": 0, "x": 1, "y": 2}
    assert X.guess_mapping(["image", "name", "x", "y"]) == {"image": 0, "name": 1, "px": 2, "py": 3}
    assert X.sniff_delimiter("a;b;c,d") == ";" and X.sniff_delimiter("a b  c") == r"\s+"


def test_xyz_lines(spark):
    lines = spark.createDataFrame([("# c",), ("",), ("1 2 3",), ("1,2,3,9",), ("1;2;3;10;20;30",), ("1 2 3 7 10 20 30",), ("a b c",)], "value string")
    got = [tuple(r) for r in X.parse_xyz(lines).collect()]
    assert got == [(1, 2, 3, None, None, None, None), (1, 2, 3, 9, None, None, None), (1, 2, 3, None, 10, 20, 30), (1, 2, 3, 7, 10, 20, 30)]


def test_control_points_take_the_first_coordinates(spark):
    rows = [(1, "A", "check", None, None, None, "i1", 1.0, 2.0), (2, "A", None, 5.0, 6.0, 0.0, None, None, None), (3, "A", None, 9.0, 9.0, 9.0, "i2", 3.0, 4.0), (4, " ", None, 1.0, 1.0, 1.0, None, None, None)]
    df = spark.createDataFrame(rows, "row int, name string, role string, x double, y double, z double, image string, px double, py double")
    got = X.build_gcps(df).collect()
    assert len(got) == 1 and tuple(got[0])[:5] == ("A", "check", 5.0, 6.0, 0.0) and [m.image for m in got[0].marks] == ["i1", "i2"]


def test_grid_and_geojson_round_trip(spark):
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 2, -2.0), (1, 1, 3.0)], "row long, col long, z double")
    lines = X.to_ascii_grid(cells, 3).orderBy("row").collect()
    assert [r.value for r in lines] == ["1.5 -9999.0 -2.0", "-9999.0 3.0 -9999.0"]
    back = X.parse_ascii_grid(spark.createDataFrame([(r.row + 6, r.value) for r in lines], "n long, value string"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    points = spark.createDataFrame([(1.0, 2.0, 3.0, "a")], "x double, y double, z double, name string")
    feature = X.to_geojson(points, ["name"]).first().value
    whole = spark.createDataFrame([(1, '{"features":[' + feature + "]}")], "id int, text string")
    r = X.geojson_points(whole).first()
    assert (r.x, r.y, r.z, r.properties) == (1.0, 2.0, 3.0, {"name": "a"})


def test_text_functions(spark):
    df = spark.createDataFrame([("a/b\\IMG_0012.JPG", " Check-Point ", "1/120", 11, 65.4321, 5 * 2**20, "2024:02:29 10:00:00")], "p string, role string, tag string, n int, t double, size long, taken string")
    roll, number = text.roll_and_number(F.col("p"))
    a, b = text.ids_of_pair(text.pair_id(F.lit(9), F.lit(4)))
    r = df.select(text.basename(F.col("p")).alias("base"), text.gcp_role(F.col("role")).alias("role"), text.tag_number(F.col("tag")).alias("tag"), text.ordinal(F.col("n")).alias("n"), text.frame_timestamp(F.col("t")).alias("t"), text.format_bytes(F.col("size")).alias("size"), number.alias("number"), a.alias("a"), b.alias("b"), text.exif_seconds(F.col("taken"), F.lit("25")).alias("s")).first()
    assert tuple(r)[:2] == ("IMG_0012.JPG", "check") and r.tag == pytest.approx(1 / 120)
    assert (r.n, r.t, r.size, r.number, r.a, r.b) == ("11th", "1:05.432", "5.0 MB", 12, 4, 9)
    assert r.s == 1709200800.25


def test_colour_round_trip(spark):
    df = spark.range(256).select(F.col("id").cast("double").alias("v"))
    r = df.select("v", color.linear_to_srgb(color.srgb_to_linear(F.col("v"))).alias("w"), color.ramp(F.col("v") / 255, "rdbu")[0].alias("red")).toPandas()
    assert np.allclose(r.v, r.w, atol=1e-3) and r.red.iloc[0] == 178 and r.red.iloc[255] == 33


def test_late_rows_are_dropped_and_batches_agree(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for k, times in enumerate((["10:01", "10:20"], ["12:05"], ["10:30", "12:10"])):
        rows = spark.sql(" UNION ALL ".join(f"SELECT timestamp'2024-01-01 {t}:00' ts, 'a' event_type, 1d value" for t in times))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.utime(tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = events.drain(events.tumbling(stream, "1 hour", "10 minutes"), "late_rows", "append").collect()
    assert {(r.start.hour, r.n) for r in out} <= {(10, 2), (10, 3), (12, 2)}


def test_journal(spark):
    key = journal.digest(stage="match", radius=3)
    assert key == journal.digest(radius=3, stage="match") != journal.digest(radius=4, stage="match")
    units = spark.range(5).withColumnRenamed("id", "unit")
    done = journal.finished(units.where("unit < 2"), key)
    assert journal.pending(units, done, key).count() == 3 and journal.pending(units, done, "other").count() == 5
