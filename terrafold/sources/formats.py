"""Other formats: kinds by content, PLY, OBJ, STL, COLMAP text, CSV, KML, DXF, GeoTIFF, archives."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: First bytes of binary formats.
MAGIC = [(b"LASF", "las"), (b"ply", "ply"), (b"\x89PNG", "png"), (b"\xff\xd8\xff", "jpeg"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"II+\0", "bigtiff"), (b"MM\0+", "bigtiff"), (b"PK\x03\x04", "zip"), (b"SQLite format 3\0", "sqlite"), (b"glTF", "glb")]


def sniff(head: bytes, name: str = "") -> tuple[str, float]:
    """(kind, confidence) of a file by its first bytes and its name."""
    for magic, kind in MAGIC:
        if head.startswith(magic):
            return kind, 1.0
    text = head.decode("utf-8", "replace")
    lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]
    if re.match(r"\s*<\?xml|\s*<document", text):
        return "xml", 0.8
    if text.lstrip().startswith("{"):
        return ("geojson", 0.9) if '"Feature' in text or '"FeatureCollection"' in text else ("json", 0.6)
    if re.match(r"ncols\s+\d+", text, re.I):
        return "asciigrid", 1.0
    if text.startswith("# Camera list") or text.startswith("# Image list") or text.startswith("# 3D point list"):
        return "colmap", 1.0
    if re.match(r"# Bundle file v", text):
        return "bundler", 1.0
    if text.startswith("NVM_V3"):
        return "nvm", 1.0
    rows = [re.split(r"[\s,;]+", x) for x in lines[:-1] or lines]
    number = re.compile(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$")
    numeric = [r for r in rows if 3 <= len(r) <= 7 and all(number.match(c) for c in r)]
    if len(numeric) >= 2 and len(numeric) == len(rows):
        return "xyz", 0.7
    if rows and any(len(r) > 1 for r in rows):
        return ("table", 0.6) if name.lower().endswith((".csv", ".txt", ".tsv")) else ("table", 0.4)
    return "unknown", 0.0


def raster_kind(bands: int, sample: str, nodata: float | None, low: float | None, high: float | None) -> str:
    """dem, ortho, multispectral or index, by bands, sample type and values."""
    if bands == 1:
        if sample.startswith("float") or nodata is not None or (sample in ("int16", "int32")):
            return "index" if low is not None and high is not None and -1 <= low and high <= 1 else "dem"
        return "ortho"
    return "ortho" if bands in (3, 4) and sample == "uint8" else "multispectral"


def pyramid(width: int, height: int, tile: int = 512, least: int = 256) -> list[tuple[int, int, int]]:
    """(level, width, height), halving until the longer side is at most `least`."""
    out, level = [(0, width, height)], 0
    while max(width, height) > least:
        width, height, level = -(-width // 2), -(-height // 2), level + 1
        out.append((level, width, height))
    return out


def tiles_for(level: int, x0: float, y0: float, x1: float, y1: float, tile: int = 512) -> list[tuple[int, int]]:
    """Tiles of a level that a rectangle of full-size pixels touches."""
    s = tile << level
    return [(c, r) for r in range(int(y0 // s), int((max(y0, y1 - 1e-9)) // s) + 1) for c in range(int(x0 // s), int((max(x0, x1 - 1e-9)) // s) + 1)]


#: Scalar types of PLY.
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


@dataclass
class PlyHeader:
    form: str
    vertices: int
    fields: list[tuple[str, str]]
    faces: int
    face_types: tuple[str, str]
    offset: int


def ply_header(raw: bytes) -> PlyHeader:
    end = raw.find(b"end_header")
    if not raw.startswith(b"ply") or end < 0:
        raise ValueError("not a PLY file")
    offset = raw.index(b"\n", end) + 1
    form, element, vertices, faces, fields, face_types = "ascii", "", 0, 0, [], ("u1", "i4")
    for line in raw[:end].decode("latin1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            element = w[1]
            vertices, faces = (int(w[2]), faces) if element == "vertex" else (vertices, int(w[2])) if element == "face" else (vertices, faces)
            if element == "face" and not fields:
                raise ValueError("faces before vertices aren't supported")
        elif w[:1] == ["property"] and element == "vertex":
            if w[1] == "list":
                raise ValueError("vertex lists aren't supported")
            fields.append((w[2], PLY_TYPES[w[1]]))
        elif w[:2] == ["property", "list"] and element == "face":
            face_types = PLY_TYPES[w[2]], PLY_TYPES[w[3]]
    return PlyHeader(form, vertices, fields, faces, face_types, offset)


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int


class PlyReader(DataSourceReader):
    """Vertices: x, y, z and the other scalar properties as a map. Binary files by record range."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"].removeprefix("file://")
        self.batch = int(options.get("records", 1 << 20))

    def header(self) -> PlyHeader:
        with open(self.path, "rb") as f:
            return ply_header(f.read(1 << 16))

    def partitions(self) -> list[Rows]:
        h = self.header()
        step = self.batch if h.form != "ascii" else max(1, h.vertices)
        return [Rows(self.path, at, min(h.vertices, at + step)) for at in range(0, h.vertices, step)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        h = self.header()
        order = ">" if "big" in h.form else "<"
        kind = np.dtype([(n, order + t) for n, t in h.fields])
        with open(part.path, "rb") as f:
            for at in range(part.first, part.last, 65_536):
                n = min(65_536, part.last - at)
                if h.form == "ascii":
                    if at == part.first:
                        f.seek(h.offset)
                    lines = [f.readline().split() for _ in range(n)]
                    p = {name: np.array([float(x[k]) for x in lines]) for k, (name, _) in enumerate(h.fields)}
                else:
                    f.seek(h.offset + at * kind.itemsize)
                    raw = np.frombuffer(f.read(n * kind.itemsize), dtype=kind)
                    p = {name: raw[name].astype(float) for name, _ in h.fields}
                names = [name for name, _ in h.fields if name not in ("x", "y", "z")]
                values = np.stack([p[k] for k in names], axis=1).ravel() if names else np.zeros(0)
                maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(names * n, pa.string()), pa.array(values, pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), *(pa.array(p[c]) for c in "xyz"), maps], names=["vid", "x", "y", "z", "extra"])


class PlySource(DataSource):
    """spark.dataSource.register(PlySource); spark.read.format("ply").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        return "vid bigint, x double, y double, z double, extra map<string,double>"

    def reader(self, schema: StructType) -> PlyReader:
        return PlyReader(dict(self.options))


def ply_faces(path: str) -> list[tuple[int, ...]]:
    """Faces of a file that the driver can hold."""
    with open(path, "rb") as f:
        raw = f.read()
    h = ply_header(raw)
    if h.form == "ascii":
        lines = raw[h.offset :].decode("latin1").split("\n")[h.vertices : h.vertices + h.faces]
        return [tuple(map(int, x.split()[1 : 1 + int(x.split()[0])])) for x in lines]
    order = ">" if "big" in h.form else "<"
    at = h.offset + h.vertices * np.dtype([(n, order + t) for n, t in h.fields]).itemsize
    count, index = (np.dtype(order + t) for t in h.face_types)
    out = []
    for _ in range(h.faces):
        n = int(np.frombuffer(raw, count, 1, at)[0])
        out.append(tuple(int(x) for x in np.frombuffer(raw, index, n, at + count.itemsize)))
        at += count.itemsize + n * index.itemsize
    return out


def ply_bytes(xyz: np.ndarray, colour: np.ndarray | None = None, faces: np.ndarray | None = None, binary: bool = True) -> bytes:
    """A PLY file of a part of a cloud or a mesh that fits a task."""
    head = ["ply", f"format {'binary_little_endian' if binary else 'ascii'} 1.0", f"element vertex {len(xyz)}", *(f"property double {c}" for c in "xyz"), *(f"property uchar {c}" for c in ("red", "green", "blue") if colour is not None)]
    if faces is not None:
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
    out = io.BytesIO()
    out.write(("\n".join([*head, "end_header"]) + "\n").encode())
    if binary:
        v = np.zeros(len(xyz), dtype=[(c, "<f8") for c in "xyz"] + ([(c, "u1") for c in "rgb"] if colour is not None else []))
        for k, c in enumerate("xyz"):
            v[c] = xyz[:, k]
        if colour is not None:
            for k, c in enumerate("rgb"):
                v[c] = colour[:, k]
        out.write(v.tobytes())
        if faces is not None:
            t = np.zeros(len(faces), dtype=[("n", "u1"), ("i", "<i4", 3)])
            t["n"], t["i"] = 3, faces
            out.write(t.tobytes())
    else:
        for k, p in enumerate(xyz):
            out.write((" ".join([*(repr(float(x)) for x in p), *(str(int(x)) for x in (colour[k] if colour is not None else ()))]) + "\n").encode())
        for f in faces if faces is not None else ():
            out.write(("3 " + " ".join(str(int(x)) for x in f) + "\n").encode())
    return out.getvalue()


def stl_bytes(corners: np.ndarray) -> bytes:
    """Binary STL of triangles (n, 3, 3)."""
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
    t = np.zeros(len(corners), dtype=[("n", "<f4", 3), ("v", "<f4", (3, 3)), ("a", "<u2")])
    t["n"], t["v"] = n, corners
    return bytes(80) + struct.pack("<I", len(corners)) + t.tobytes()


def colmap_images(lines: DataFrame) -> DataFrame:
    """(image_id, qw..tz, camera_id, name, points) of numbered lines (n, value) of images.txt.

    An image takes two lines; comments and blank lines before the first are left out by the caller's
    numbering (see numbered_lines).
    """
    pose = lines.where("n % 2 = 0").select((F.col("n") / 2).cast("bigint").alias("k"), F.split("value", " ", 10).alias("w"))
    marks = lines.where("n % 2 = 1").select(((F.col("n") - 1) / 2).cast("bigint").alias("k"), F.col("value").alias("points"))
    at = lambda i, t: F.get("w", F.lit(i)).try_cast(t)
    names = ["qw", "qx", "qy", "qz", "tx", "ty", "tz"]
    return pose.join(marks, "k", "left").select(at(0, "int").alias("image_id"), *[at(i + 1, "double").alias(c) for i, c in enumerate(names)], at(8, "int").alias("camera_id"), F.get("w", F.lit(9)).alias("name"), "points")


def colmap_observations(images: DataFrame) -> DataFrame:
    """(image_id, kp, x, y, point_id): the second lines exploded; -1 becomes null."""
    triples = F.split(F.trim("points"), r"\s+")
    n = F.floor(F.size(triples) / 3).cast("int")
    k = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)))
    out = images.withColumn("t", triples).select("image_id", "t", k.alias("kp"))
    at = lambda i, t: F.get("t", F.col("kp") * 3 + i).try_cast(t)
    return out.select("image_id", "kp", at(0, "double").alias("x"), at(1, "double").alias("y"), F.when(at(2, "bigint") >= 0, at(2, "bigint")).alias("point_id"))


def colmap_points(lines: DataFrame) -> DataFrame:
    """(point_id, x, y, z, r, g, b, error, track as alternating image and keypoint) of points3D.txt lines."""
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(w.alias("w"))
    at = lambda i, t: F.get("w", F.lit(i)).try_cast(t)
    return rows.select(at(0, "bigint").alias("point_id"), *[at(i + 1, "double").alias(c) for i, c in enumerate("xyz")], *[at(i + 4, "int").alias(c) for i, c in enumerate("rgb")], at(7, "double").alias("error"), F.transform(F.slice("w", 9, F.greatest(F.lit(0), F.size("w") - 8)), lambda x: x.try_cast("int")).alias("track"))


#: Terms of each camera model by its number.
CAMERA_TERMS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}


def colmap_binary(raw: bytes, kind: str) -> list[dict]:
    """Records of cameras.bin, images.bin or points3D.bin (kind: cameras, images, points3D)."""
    out, at = [], 8
    for _ in range(struct.unpack_from("<Q", raw, 0)[0]):
        if kind == "cameras":
            camera, model, width, height = struct.unpack_from("<iiQQ", raw, at)
            if model not in CAMERA_TERMS:
                raise ValueError(f"camera model {model} isn't known")
            n = CAMERA_TERMS[model]
            out.append({"camera_id": camera, "model": model, "width": width, "height": height, "params": list(struct.unpack_from(f"<{n}d", raw, at + 24))})
            at += 24 + 8 * n
        elif kind == "images":
            image, *pose = struct.unpack_from("<I7d", raw, at)
            camera = struct.unpack_from("<I", raw, at + 60)[0]
            end = raw.index(b"\0", at + 64)
            n = struct.unpack_from("<Q", raw, end + 1)[0]
            points = np.frombuffer(raw, dtype=[("x", "<f8"), ("y", "<f8"), ("p", "<i8")], count=n, offset=end + 9)
            out.append({"image_id": image, **dict(zip(["qw", "qx", "qy", "qz", "tx", "ty", "tz"], pose, strict=True)), "camera_id": camera, "name": raw[at + 64 : end].decode("utf-8", "replace"), "points": [(float(x), float(y), None if p < 0 else int(p)) for x, y, p in points.tolist()]})
            at = end + 9 + 24 * n
        elif kind == "points3D":
            point, x, y, z, r, g, b, error, n = struct.unpack_from("<Q3d3BdQ", raw, at)
            out.append({"point_id": point, "x": x, "y": y, "z": z, "r": r, "g": g, "b": b, "error": error, "track": list(struct.unpack_from(f"<{2 * n}i", raw, at + 51))})
            at += 51 + 8 * n
        else:
            raise ValueError(f"{kind} isn't a part of a model")
    return out


COLMAP_SCHEMAS = {
    "cameras": "camera_id int, model int, width long, height long, params array<double>",
    "images": "image_id long, qw double, qx double, qy double, qz double, tx double, ty double, tz double, camera_id long, name string, points array<struct<x:double,y:double,point_id:bigint>>",
    "points3D": "point_id long, x double, y double, z double, r int, g int, b int, error double, track array<int>",
}


def read_colmap_binary(files: DataFrame, kind: str) -> DataFrame:
    """Records of binary model files (path, content), one task a file; kind as of colmap_binary."""

    def parse(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([r for raw in pdf["content"] for r in colmap_binary(bytes(raw), kind)], columns=[c.split()[0] for c in COLMAP_SCHEMAS[kind].split(", ")])

    return files.select("path", "content").groupBy("path").applyInPandas(parse, COLMAP_SCHEMAS[kind])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): content lines of one text file in order, comments left out.

    Offsets within a file are what orders lines, so the file is read whole by one task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: ~x.startswith("#"))).alias("n", "value"))
    return whole.select("n", "value")


def kml_points(points: DataFrame) -> DataFrame:
    """(value): a placemark a row (name, lon, lat, h)."""
    return points.select(F.concat(F.lit("<Placemark><name>"), F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;"), F.lit("</name><Point><coordinates>"), F.concat_ws(",", "lon", "lat", "h"), F.lit("</coordinates></Point></Placemark>")).alias("value"))


def dxf_lines(lines: list[tuple[str, list[tuple[float, float, float]]]]) -> str:
    """DXF R12 of polylines by layer."""
    out = ["0", "SECTION", "2", "ENTITIES"]
    for layer, points in lines:
        out += ["0", "POLYLINE", "8", layer, "66", "1", "70", "8"]
        for x, y, z in points:
            out += ["0", "VERTEX", "8", layer, "10", repr(x), "20", repr(y), "30", repr(z), "70", "32"]
        out += ["0", "SEQEND"]
    return "\n".join([*out, "0", "ENDSEC", "0", "EOF"]) + "\n"


def geotiff_bytes(data: np.ndarray, gsd: float, origin_x: float, origin_y: float, epsg: int | None = None, geographic: bool = False, nodata: float | None = None) -> bytes:
    """A GeoTIFF of one block: strips of rows, float32 or the array's own type; no code, no GeoKeys."""
    a = np.atleast_3d(data)
    a = a.astype("<f4") if a.dtype.kind == "f" else a.astype(a.dtype.newbyteorder("<"))
    h, w, bands = a.shape
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    tags: list[tuple[int, int, list]] = [
        (256, 4, [w]), (257, 4, [h]), (258, 3, [a.dtype.itemsize * 8] * bands), (259, 3, [1]), (262, 3, [2 if bands >= 3 else 1]),
        (277, 3, [bands]), (278, 4, [h]), (279, 4, [a.nbytes]), (284, 3, [1]), (339, 3, [kind] * bands),
        (33550, 12, [gsd, gsd, 0.0]), (33922, 12, [0.0, 0.0, 0.0, origin_x, origin_y, 0.0]),
    ]
    if epsg is not None:
        tags.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, epsg]))
    if nodata is not None:
        tags.append((42113, 2, [f"{nodata:g}".encode() + b"\0"]))
    tags.append((273, 4, [0]))
    tags.sort()
    form = {3: "H", 4: "I", 12: "d"}
    blobs = [v[0] if t == 2 else struct.pack(f"<{len(v)}{form[t]}", *v) for _, t, v in tags]
    at = 8 + 2 + 12 * len(tags) + 4
    places, extra = [], b""
    for b in blobs:
        places.append(at + len(extra) if len(b) > 4 else None)
        extra += b + b"\0" * (len(b) % 2) if len(b) > 4 else b""
    start = at + len(extra)
    out = b"II*\0" + struct.pack("<IH", 8, len(tags))
    for (tag, t, v), b, place in zip(tags, blobs, places, strict=True):
        if tag == 273:
            b = struct.pack("<I", start)
        out += struct.pack("<HHI", tag, t, len(b) if t == 2 else len(v)) + (struct.pack("<I", place) if place is not None else b.ljust(4, b"\0"))
    return out + struct.pack("<I", 0) + extra + a.tobytes()


def read_archive(raw: bytes, wanted, entries: int = 10_000, size: int = 1 << 30) -> dict[str, bytes]:
    """Members of a zip archive that wanted(name) takes, within limits and safe paths."""
    out, total = {}, 0
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.infolist()
        if len(names) > entries:
            raise ValueError(f"over {entries} entries")
        for i in names:
            if i.is_dir() or not wanted(i.filename):
                continue
            if i.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", i.filename) or ":" in i.filename:
                raise ValueError(f"unsafe path {i.filename}")
            total += i.file_size
            if total > size:
                raise ValueError(f"over {size} bytes")
            out[i.filename] = z.read(i)
    return out
