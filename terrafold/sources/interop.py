"""Models of other tools: feature blobs, cameras and points as rows, poses out, metadata in.

These files describe a project and fit the driver; their rows become DataFrames.
"""

from __future__ import annotations

import json
import re
import sqlite3

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions.text import MAX_ID


def keypoint_blob(rows: int, cols: int, data: bytes) -> np.ndarray:
    """x, y, scale, orientation of float32 keypoints: 2, 4 (scale, angle) or 6 (affine) columns."""
    a = np.frombuffer(data, dtype="<f4").reshape(rows, cols).astype(float)
    if cols == 2:
        return np.column_stack((a, np.ones(rows), np.zeros(rows)))
    if cols == 4:
        return a
    scale = (np.hypot(a[:, 2], a[:, 4]) + np.hypot(a[:, 3], a[:, 5])) / 2
    return np.column_stack((a[:, :2], scale, np.arctan2(a[:, 4], a[:, 2])))


def match_blob(rows: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4").reshape(rows, 2).astype(np.int64)


def read_database(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, keypoints and matches of a feature database (SQLite)."""
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        images = con.execute("SELECT image_id, name, camera_id FROM images").fetchall()
        keypoints = [(i, k, *map(float, p)) for i, r, c, d in con.execute("SELECT image_id, rows, cols, data FROM keypoints") if r for k, p in enumerate(keypoint_blob(r, c, d))]
        matches = [(*pair_of(p), *map(int, m)) for p, r, d in con.execute("SELECT pair_id, rows, data FROM matches") if r for m in match_blob(r, d)]
    finally:
        con.close()
    return {
        "images": spark.createDataFrame(images, "image_id bigint, name string, camera_id bigint"),
        "keypoints": spark.createDataFrame(keypoints, "image_id bigint, kp int, x double, y double, scale double, angle double"),
        "matches": spark.createDataFrame(matches, "id_a bigint, id_b bigint, kp_a bigint, kp_b bigint"),
    }


def pair_of(pair: int) -> tuple[int, int]:
    return (pair - pair % MAX_ID) // MAX_ID, pair % MAX_ID


def parse_nvm(text: str) -> tuple[list[tuple], list[tuple]]:
    """(cameras: name, focal, qw..qz, cx..cz), (points: x, y, z, r, g, b, marks)."""
    lines = iter([x.strip() for x in text.splitlines() if x.strip()][1:])
    cameras = []
    for _ in range(int(next(lines))):
        w = next(lines).split()
        cameras.append((" ".join(w[:-10]), *map(float, w[-10:-2])))
    points = []
    for _ in range(int(next(lines, "0"))):
        w = next(lines).split()
        marks = [(int(w[7 + 4 * k]), int(w[8 + 4 * k]), float(w[9 + 4 * k]), float(w[10 + 4 * k])) for k in range(int(w[6]))]
        points.append((*map(float, w[:3]), *map(int, w[3:6]), marks))
    return cameras, points


def parse_bundler(text: str) -> tuple[list[tuple], list[tuple]]:
    """(cameras: focal, k1, k2, R, t), (points: x, y, z, r, g, b, marks)."""
    numbers = iter(re.sub(r"#.*", "", text).split())
    n, m = int(next(numbers)), int(next(numbers))
    take = lambda k: [float(next(numbers)) for _ in range(k)]
    cameras = [(*take(3), take(9), take(3)) for _ in range(n)]
    points = []
    for _ in range(m):
        xyz, rgb = take(3), [int(v) for v in take(3)]
        points.append((*xyz, *rgb, [(int(next(numbers)), int(next(numbers)), *take(2)) for _ in range(int(next(numbers)))]))
    return cameras, points


def parse_transforms(text: str) -> list[tuple]:
    """(name, fx, fy, cx, cy, matrix rows) of a transforms.json."""
    j = json.loads(text)
    own = lambda f, k: f.get(k, j.get(k))
    out = []
    for f in j.get("frames", []):
        w = own(f, "w")
        fx = own(f, "fl_x") or (w / (2 * np.tan(own(f, "camera_angle_x") / 2)) if w and own(f, "camera_angle_x") else None)
        out.append((f["file_path"], fx, own(f, "fl_y") or fx, own(f, "cx"), own(f, "cy"), f["transform_matrix"]))
    return out


def colmap_image_lines(images: DataFrame) -> DataFrame:
    """(image_id, line, value): two lines an image, pixels moved to the half-pixel convention.

    images: image_id, qw..tz, camera_id, name, marks (array of x, y, point_id).
    """
    pose = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("image_id", "qw", "qx", "qy", "qz", "tx", "ty", "tz", "camera_id", "name")])
    mark = F.concat_ws(" ", F.transform("marks", lambda m: F.concat_ws(" ", (m["x"] + 0.5).cast("string"), (m["y"] + 0.5).cast("string"), F.coalesce(m["point_id"], F.lit(-1)).cast("string"))))
    both = F.explode(F.array(F.struct(F.lit(0).alias("line"), pose.alias("value")), F.struct(F.lit(1).alias("line"), mark.alias("value"))))
    return images.select("image_id", both.alias("l")).select("image_id", "l.line", "l.value")


def normalize_metadata(rows: DataFrame) -> DataFrame:
    """Flat, typed metadata of images (columns as text): focal, exposure, time, position, attitude.

    rows: image_id, focal, exposure, taken, subsec, lat, lat_ref, lon, lon_ref, alt, alt_ref, yaw, pitch, roll.
    """
    from terrafold.functions.text import exif_seconds, tag_number

    signed = lambda c, minus: tag_number(F.col(c)) * F.when(F.upper(f"{c}_ref").isin(*minus), -1).otherwise(1)
    return rows.select("image_id", tag_number(F.col("focal")).alias("focal"), tag_number(F.col("exposure")).alias("exposure"), exif_seconds(F.col("taken"), F.col("subsec")).alias("t"), signed("lat", ["S"]).alias("lat"), signed("lon", ["W"]).alias("lon"), signed("alt", ["1"]).alias("alt"), *[F.col(c).try_cast("double").alias(c) for c in ("yaw", "pitch", "roll")])
