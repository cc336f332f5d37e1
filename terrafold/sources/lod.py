"""Octrees in files and out of them: COPC hierarchies, LAS 1.4 records, 3D Tiles trees and annotations.

A node's key is (level, nx, ny, nz), its cube a part of the root's. Decoding LASzip chunks is injected.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.sources import las

ENTRY = 32
#: Point formats of the files.
COPC_FORMATS = (6, 7, 8)


@dataclass
class CopcInfo:
    centre: tuple[float, float, float]
    half: float
    spacing: float
    page: tuple[int, int]  # offset, length of the root's page
    point_format: int
    record_length: int
    count: int


def read_copc_info(head: bytes) -> CopcInfo:
    """head: the file's bytes up to its first record. Its first variable record must be the COPC one."""
    if head[:4] != b"LASF":
        raise ValueError("not a LAS file")
    size = struct.unpack_from("<H", head, 94)[0]
    kind, length, _ = struct.unpack_from("<BHI", head, 104)
    user, record, n = struct.unpack_from("<2x16sHH", head, size)
    if user.rstrip(b"\0") != b"copc" or record != 1 or n < 160:
        raise ValueError("no COPC record comes first")
    if kind & 0x3F not in COPC_FORMATS:
        raise ValueError(f"point format {kind & 0x3F} in a COPC file")
    at = size + 54
    x, y, z, half, spacing = struct.unpack_from("<5d", head, at)
    offset, page = struct.unpack_from("<2Q", head, at + 40)
    if not half > 0 or page < ENTRY:
        raise ValueError("the root's cube or page is broken")
    return CopcInfo((x, y, z), half, spacing, (offset, page), kind & 0x3F, length, struct.unpack_from("<Q", head, 247)[0])


def parse_page(raw: bytes) -> list[tuple[int, int, int, int, int, int, int]]:
    """(level, nx, ny, nz, offset, length, count) of each entry; count -1 is another page."""
    out = []
    for at in range(0, len(raw) - ENTRY + 1, ENTRY):
        level, nx, ny, nz, offset, length, count = struct.unpack_from("<4iQ2i", raw, at)
        out.append((level, nx, ny, nz, offset, length, count))
    return out


def hierarchy(read: Callable[[int, int], bytes], info: CopcInfo, box: tuple[float, ...] | None = None, most_level: int | None = None, most_nodes: int = 50_000_000) -> list[tuple]:
    """Nodes with points, of the pages a box and level reach; a page is read once.

    read(offset, length). box: x0, y0, z0, x1, y1, z1. A broken file with pages in a ring, or of over
    most_nodes nodes, is an error.
    """
    pages, seen, out = [info.page], set(), {}
    while pages:
        page = pages.pop()
        if page in seen:
            raise ValueError("a page of the hierarchy is named twice")
        seen.add(page)
        for level, nx, ny, nz, offset, length, count in parse_page(read(*page)):
            if most_level is not None and level > most_level:
                continue
            low, edge = node_cube(info, level, nx, ny, nz)
            if box is not None and any(low[k] > box[3 + k] or low[k] + edge < box[k] for k in range(3)):
                continue
            if count == -1:
                pages.append((offset, length))
            elif count > 0:
                out[level, nx, ny, nz] = (level, nx, ny, nz, offset, length, count)
        if len(out) > most_nodes:
            raise ValueError(f"over {most_nodes} nodes")
    return sorted(out.values())


def node_cube(info: CopcInfo, level: int, nx: int, ny: int, nz: int) -> tuple[tuple[float, float, float], float]:
    """The least corner of a node's cube, and its edge."""
    edge = 2 * info.half / 2**level
    return tuple(c - info.half + k * edge for c, k in zip(info.centre, (nx, ny, nz), strict=True)), edge


def read_copc(spark, path: str, decode: Callable[[bytes, int, int, int], bytes], box: tuple[float, ...] | None = None, most_level: int | None = None) -> DataFrame:
    """Points (x, y, z, level, classification) of the nodes a box and level reach.

    decode(chunk, count, point_format, record_length) gives a chunk's records. The node list is the list of
    partitions: each task reads the chunks of its nodes; points outside the box go.
    """
    local = path.removeprefix("file://")

    def part(offset: int, length: int) -> bytes:
        with open(local, "rb") as f:
            f.seek(offset)
            return f.read(length)

    info = read_copc_info(part(0, struct.unpack_from("<I", part(0, 375), 96)[0]))
    head = part(0, 375)
    scale, shift = struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155)
    nodes = spark.createDataFrame(hierarchy(part, info, box, most_level), "level int, nx long, ny long, nz long, offset long, length int, count int")
    header = las.Header((1, 4), info.point_format, info.record_length, info.count, 0, scale, shift)

    def load(batches):
        with open(local, "rb") as f:
            for pdf in batches:
                for n in pdf.itertuples():
                    f.seek(n.offset)
                    got = las.decode(header, decode(f.read(n.length), n.count, info.point_format, info.record_length), 0)
                    yield pd.DataFrame({"x": got["x"], "y": got["y"], "z": got["z"], "level": np.full(n.count, n.level, dtype=np.int32), "classification": got["classification"]})

    points = nodes.repartitionByRange("level", "nx", "ny", "nz").mapInPandas(load, "x double, y double, z double, level int, classification int")
    if box is None:
        return points
    return points.where(F.col("x").between(box[0], box[3]) & F.col("y").between(box[1], box[4]) & F.col("z").between(box[2], box[5]))


def encode14(xyz: np.ndarray, colour: np.ndarray | None = None, scale: float = 0.001, fields: dict[str, np.ndarray] | None = None, wkt: str | None = None) -> bytes:
    """A LAS 1.4 file of format 6, or 7 with colour (8 bits), for a part of a cloud that fits a task.

    fields: intensity, return_number, returns, classification, user_data, scan_angle (degrees), point_source, gps_time.
    """
    n, kind, fields = len(xyz), 7 if colour is not None else 6, fields or {}
    shift = np.floor(xyz.min(axis=0)) if n else np.zeros(3)
    p = np.zeros(n, dtype=np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), *las.FORMATS[kind]]))
    for k, c in enumerate("XYZ"):
        p[c] = np.rint((xyz[:, k] - shift[k]) / scale) if n else []
    number, returns = (np.asarray(fields.get(c, np.ones(n)), dtype=int) for c in ("return_number", "returns"))
    p["flags"] = (number & 15) | (returns & 15) << 4
    for c in ("intensity", "classification", "user_data", "point_source", "gps_time"):
        if c in fields:
            p[c] = fields[c]
    if "scan_angle" in fields:
        p["scan_angle"] = np.rint(np.asarray(fields["scan_angle"]) / 0.006)
    if colour is not None:
        for k, c in enumerate("rgb"):
            p[c] = np.asarray(colour)[:, k].astype(np.uint16) * 257
    record = b""
    if wkt is not None:
        text = wkt.encode() + b"\0"
        record = struct.pack("<H16sHH32s", 0, b"LASF_Projection", 2112, len(text), b"") + text
    head = bytearray(375)
    head[:4], head[24:26] = b"LASF", bytes([1, 4])
    struct.pack_into("<H", head, 6, 1 << 4)
    struct.pack_into("<HII", head, 94, 375, 375 + len(record), int(bool(record)))
    struct.pack_into("<BH", head, 104, kind, p.dtype.itemsize)
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *shift)
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    by = np.bincount(np.clip(number, 0, 15), minlength=16)[1:16] if n else np.zeros(15, dtype=int)
    struct.pack_into("<Q15Q", head, 247, n, *(int(v) for v in by))
    return bytes(head) + record + p.tobytes()


def export_nodes(points: DataFrame, folder: str, form: str = "las", colour: bool = False) -> DataFrame:
    """(level, nx, ny, nz, path, n): a file for each node, LAS 1.4 or text (x y z), written by the node's task.

    points: level, nx, ny, nz, x, y, z and, with colour, r, g, b. A node holds a bounded number of points.
    """
    local = folder.removeprefix("file://")

    def put(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        os.makedirs(local, exist_ok=True)
        pdf = pdf.sort_values(["x", "y", "z"], kind="stable")
        path = f"{local}/{'-'.join(str(int(k)) for k in key)}.{'las' if form == 'las' else 'xyz'}"
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        body = encode14(xyz, pdf[["r", "g", "b"]].to_numpy() if colour else None) if form == "las" else "".join(f"{x:.3f} {y:.3f} {z:.3f}\n" for x, y, z in xyz).encode()
        with open(f"{path}.part", "wb") as f:
            f.write(body)
        os.replace(f"{path}.part", path)  # a task that is run again writes the same file
        return pd.DataFrame({"level": [key[0]], "nx": [key[1]], "ny": [key[2]], "nz": [key[3]], "path": [path], "n": [len(pdf)]})

    columns = ["level", "nx", "ny", "nz", "x", "y", "z", *("rgb" if colour else "")]
    return points.select(*columns).groupBy("level", "nx", "ny", "nz").applyInPandas(put, "level int, nx long, ny long, nz long, path string, n long")


def tile_bounds(nodes: DataFrame, levels: int) -> DataFrame:
    """nodes with bounds that hold their children's too, and errors of at least theirs.

    nodes: level, nx, ny, nz, x0, y0, z0, x1, y1, z1, error. Each node is told to all its ancestors: a row
    for each level, and one grouping.
    """
    up = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("level"), F.lit(levels)))))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("k"))).cast("bigint")
    told = up.select((F.col("level") - F.col("k")).alias("level"), *[at(c).alias(c) for c in ("nx", "ny", "nz")], *[F.col(f"{c}{e}") for c in "xyz" for e in "01"], "error", (F.col("k") == 0).alias("own"))
    box = [F.min(f"{c}0").alias(f"{c}0") for c in "xyz"] + [F.max(f"{c}1").alias(f"{c}1") for c in "xyz"]
    return told.groupBy("level", "nx", "ny", "nz").agg(*box, F.max("error").alias("error"), F.max("own").alias("content"))


def tileset(bounds: DataFrame, every: int = 5, above: int = 2000, refine: str = "ADD", transform: list[float] | None = None) -> DataFrame:
    """(name, json): the tileset's files. bounds: of tile_bounds.

    Beyond `above` tiles a file ends every `every` levels: the tile there names the next file instead
    of its children. Each file is made by one task, from the tiles of its own levels.
    """
    total = bounds.count()
    split = every if total > above and every > 0 else 0
    top = F.floor(F.col("level") / split) * split if split else F.lit(0)
    up = F.col("level") - top
    own = bounds.withColumn("f", top.cast("int")).withColumns({f"f{c}": F.floor(F.col(f"n{c}") / F.pow(F.lit(2.0), up)).cast("bigint") for c in "xyz"})
    if split:
        # The first tile of a file also stands, without content, in the file above.
        ends = bounds.where(f"level > 0 and level % {split} = 0").withColumn("f", (F.col("level") - split).cast("int"))
        ends = ends.withColumns({f"f{c}": F.floor(F.col(f"n{c}") / 2.0**split).cast("bigint") for c in "xyz"})
        own = own.withColumn("link", F.lit(False)).unionByName(ends.withColumn("link", F.lit(True)))
    else:
        own = own.withColumn("link", F.lit(False))

    def write(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0])
        tiles = {}
        for r in pdf.sort_values(["level", "nx", "ny", "nz", "link"]).to_dict("records"):
            low, high = ([r[f"{c}{e}"] for c in "xyz"] for e in "01")
            half = [(b - a) / 2 for a, b in zip(low, high, strict=True)]
            middle = [(a + b) / 2 for a, b in zip(low, high, strict=True)]
            box = [*middle, half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]
            name = f"{int(r['level'])}-{int(r['nx'])}-{int(r['ny'])}-{int(r['nz'])}"
            where = "tiles/" if first == 0 else ""
            tile = {"boundingVolume": {"box": box}, "geometricError": r["error"]}
            if r["link"]:
                tile["content"] = {"uri": f"{where}{name}.json"}
            elif r["content"]:
                tile["content"] = {"uri": f"{where}{name}.glb"}
            tiles[int(r["level"]), int(r["nx"]), int(r["ny"]), int(r["nz"]), bool(r["link"])] = tile
        root = None
        for (level, nx, ny, nz, link), tile in tiles.items():
            parent = tiles.get((level - 1, nx // 2, ny // 2, nz // 2, False))
            if parent is not None and (link or level > first):
                parent.setdefault("children", []).append(tile)
            elif not link and level == first:
                root = tile
        root = root | {"refine": refine}
        error = root["geometricError"]
        if first == 0:
            box = root["boundingVolume"]["box"]
            error = max(2 * error, max(box[3], box[7], box[11]) / 4)
            if transform:
                root["transform"] = transform
        body = {"asset": {"version": "1.1"}, "geometricError": error, "root": root}
        name = "tileset.json" if first == 0 else f"tiles/{first}-{int(key[1])}-{int(key[2])}-{int(key[3])}.json"
        return pd.DataFrame({"name": [name], "json": [json.dumps(body, sort_keys=True)]})

    return own.groupBy("f", "fx", "fy", "fz").applyInPandas(write, "name string, json string")


def annotations(grids: DataFrame, lon: Column, lat: Column, version: int = 2) -> DataFrame:
    """(image_id, json): a georeference annotation for each photograph that lands on three nodes at least.

    grids: image_id, uri, width, height, i, j (a node's column and row), u, v (its place in the photograph,
    0 to 1) and what lon and lat are made of; a node that doesn't land has a null lon. The outline goes down the
    first nodes of the rows that have any, along the last row, and up again.
    """
    kind = {2: "ImageService2", 3: "ImageService3"}[version]
    landed = grids.withColumns({"_lon": F.round(lon, 9), "_lat": F.round(lat, 9)}).where("_lon is not null and _lat is not null")
    px, py = F.round(F.col("u") * F.col("width"), 2), F.round(F.col("v") * F.col("height"), 2)
    node = landed.withColumns({"_x": px, "_y": py})
    span = Window.partitionBy("image_id", "j")
    rim = node.withColumns({"_lo": F.min("i").over(span), "_hi": F.max("i").over(span)})
    rows = Window.partitionBy("image_id")
    rim = rim.withColumns({"_top": F.min("j").over(rows), "_bottom": F.max("j").over(rows)})
    left, right = F.col("i") == F.col("_lo"), F.col("i") == F.col("_hi")
    side = F.when(left, 0).when(F.col("j") == F.col("_bottom"), 1).when(right, 2).when(F.col("j") == F.col("_top"), 3)
    along = F.when(side == 0, F.col("j")).when(side == 1, F.col("i")).when(side == 2, -F.col("j")).otherwise(-F.col("i"))
    told = rim.withColumns({"_side": side, "_along": along})
    number = lambda c: F.regexp_replace(F.format_string("%.2f", c), r"\.?0+$", "")
    corner = F.when(F.col("_side").isNotNull(), F.struct("_side", "_along", F.concat(number(F.col("_x")), F.lit(","), number(F.col("_y"))).alias("p")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.array("_x", "_y").alias("resourceCoords")).alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("_lon", "_lat").alias("coordinates")).alias("geometry"))
    every = told.groupBy("image_id", "uri", "width", "height").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "i", feature.alias("f")))), lambda s: s["f"]).alias("features"), F.array_join(F.transform(F.array_sort(F.collect_list(corner)), lambda s: s["p"]), " ").alias("ring"), F.count_distinct("j").alias("rows"))
    size = F.format_string('width="%d" height="%d"', F.col("width").cast("long"), F.col("height").cast("long"))
    svg = F.concat(F.lit("<svg "), size, F.lit('><polygon points="'), F.col("ring"), F.lit('" /></svg>'))
    source = F.struct(F.col("uri").alias("id"), F.lit(kind).alias("type"), F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))
    target = F.struct(F.lit("SpecificResource").alias("type"), source.alias("source"), F.struct(F.lit("SvgSelector").alias("type"), svg.alias("value")).alias("selector"))
    body = F.struct(F.lit("FeatureCollection").alias("type"), F.struct(F.lit("thinPlateSpline").alias("type")).alias("transformation"), F.col("features").alias("features"))
    context = F.array(F.lit("http://iiif.io/api/extension/georef/1/context.json"), F.lit("http://iiif.io/api/presentation/3/context.json"))
    note = F.to_json(F.struct(F.lit("Annotation").alias("type"), context.alias("@context"), F.lit("georeferencing").alias("motivation"), target.alias("target"), body.alias("body")))
    return every.where("size(features) >= 3 and rows >= 2").select("image_id", note.alias("json"))
