"""LAS 1.0 to 1.4 point files: header, extra bytes, a data source by record range, a writer.

A reader partition is a range of records, so a file of any size is read by many tasks, each
seeking to its own records. Files are reached by local or mounted paths.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Fields of each point format after x, y, z (name, numpy type).
_OLD = [("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("point_source", "<u2")]
_NEW = [("intensity", "<u2"), ("flags", "u1"), ("flags2", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source", "<u2"), ("gps_time", "<f8")]
_RGB = [("r", "<u2"), ("g", "<u2"), ("b", "<u2")]
_GPS = [("gps_time", "<f8")]
FORMATS = {0: _OLD, 1: _OLD + _GPS, 2: _OLD + _RGB, 3: _OLD + _GPS + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: [*_NEW, *_RGB, ("nir", "<u2")]}
#: Types of extra bytes by code.
EXTRA = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}

SCHEMA = "pid bigint, x double, y double, z double, intensity int, return_number int, returns int, classification int, scan_angle double, user_data int, point_source int, gps_time double, r int, g int, b int, extra map<string,double>"


@dataclass
class Header:
    version: tuple[int, int]
    point_format: int
    record_length: int
    count: int
    offset: int
    scale: tuple[float, float, float]
    shift: tuple[float, float, float]
    extra: list[tuple[str, str, float, float]] = field(default_factory=list)  # name, type, scale, add


def read_header(raw: bytes) -> Header:
    """raw: the file's bytes up to its first record at least."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = raw[24], raw[25]
    size, offset, records = struct.unpack_from("<HII", raw, 94)
    kind, length, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed records (LAZ) aren't supported")
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    if minor >= 4 and size >= 375:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    extra, at = [], size
    for _ in range(records):
        user, record, n = struct.unpack_from("<2x16sHH", raw, at)
        if user.rstrip(b"\0") == b"LASF_Spec" and record == 4:
            for k in range(at + 54, at + 54 + n, 192):
                code, options = raw[k + 2], raw[k + 3]
                name = raw[k + 4 : k + 36].split(b"\0")[0].decode("utf-8", "replace")
                s, a = struct.unpack_from("<d", raw, k + 112)[0], struct.unpack_from("<d", raw, k + 136)[0]
                if code in EXTRA:
                    extra.append((name, EXTRA[code], s if options & 8 else 1.0, a if options & 16 else 0.0))
        at += 54 + n
    return Header((major, minor), kind, length, count, offset, scale, shift, extra)


def record_type(h: Header) -> np.dtype:
    if h.point_format not in FORMATS:
        raise ValueError(f"point format {h.point_format} isn't supported")
    fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), *FORMATS[h.point_format]]
    fields += [(f"+{k}", t) for k, (_, t, _, _) in enumerate(h.extra)]
    own = np.dtype(fields).itemsize
    if own > h.record_length:
        raise ValueError("records are shorter than their fields")
    return np.dtype([*fields, *([("pad", f"V{h.record_length - own}")] if own < h.record_length else [])])


def decode(h: Header, raw: bytes, first: int) -> dict[str, np.ndarray]:
    """Columns of some records; colour of 8 bits is told by no value over 255."""
    p = np.frombuffer(raw, dtype=record_type(h))
    n, names = len(p), p.dtype.names
    out = {"pid": np.arange(first, first + n)}
    for c, s, a in zip("xyz", h.scale, h.shift, strict=True):
        out[c] = p[c.upper()] * s + a
    new = h.point_format >= 6
    flags = p["flags"]
    out["intensity"] = p["intensity"].astype(np.int32)
    out["return_number"] = (flags & (15 if new else 7)).astype(np.int32)
    out["returns"] = ((flags >> 4) if new else (flags >> 3 & 7)).astype(np.int32)
    out["classification"] = (p["classification"] if new else p["classification"] & 31).astype(np.int32)
    out["scan_angle"] = p["scan_angle"] * (0.006 if new else 1.0)
    out["user_data"], out["point_source"] = p["user_data"].astype(np.int32), p["point_source"].astype(np.int32)
    out["gps_time"] = p["gps_time"] if "gps_time" in names else None
    for c in "rgb":
        out[c] = p[c].astype(np.int32) if c in names else None
    out["extra"] = {name: p[f"+{k}"] * s + a for k, (name, _, s, a) in enumerate(h.extra)}
    return out


@dataclass
class Records(InputPartition):
    path: str
    first: int
    last: int


class LasReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.batch = int(options.get("records", 1 << 20))

    def header(self, path: str) -> Header:
        with open(path.removeprefix("file://"), "rb") as f:
            head = f.read(375)
            f.seek(0)
            return read_header(f.read(struct.unpack_from("<I", head, 96)[0]))

    def partitions(self) -> list[Records]:
        return [Records(p, at, min(n, at + self.batch)) for p in self.paths for n in [self.header(p).count] for at in range(0, n, self.batch)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        h = self.header(part.path)
        with open(part.path.removeprefix("file://"), "rb") as f:
            for at in range(part.first, part.last, 65_536):
                n = min(65_536, part.last - at)
                f.seek(h.offset + at * h.record_length)
                got = decode(h, f.read(n * h.record_length), at)
                extra = got.pop("extra")
                names = list(extra)
                cols = [pa.nulls(n, pa.int32() if c in "rgb" else pa.float64()) if x is None else pa.array(x) for c, x in got.items()]
                values = np.stack([extra[k] for k in names], axis=1).ravel() if names else np.zeros(0)
                maps = pa.MapArray.from_arrays(pa.array(np.arange(n + 1) * len(names), pa.int32()), pa.array(names * n, pa.string()), pa.array(values, pa.float64()))
                yield pa.RecordBatch.from_arrays([*cols, maps], names=[*got, "extra"])


class LasSource(DataSource):
    """spark.dataSource.register(LasSource); spark.read.format("las").load(path)."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LasReader:
        return LasReader(dict(self.options))


def plan_fields(points: DataFrame, names: list[str]) -> dict[str, str]:
    """Where each attribute goes: its standard field if all values fit, else extra bytes, else dropped."""
    room = {"intensity": (0, 65535), "classification": (0, 31), "user_data": (0, 255), "point_source": (0, 65535), "scan_angle": (-128, 127)}
    ranges = points.agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in (("low", F.min), ("high", F.max))], *[F.max((F.col(c) != F.floor(c)).cast("int")).alias(f"{c}_part") for c in names]).first()
    out = {}
    for c in names:
        low, high = ranges[f"{c}_low"], ranges[f"{c}_high"]
        if low is None:
            out[c] = "dropped"
        else:
            out[c] = "standard" if c in room and room[c][0] <= low and high <= room[c][1] and not ranges[f"{c}_part"] else "extra"
    return out


def encode(xyz: np.ndarray, colour: np.ndarray | None = None, scale: float = 0.001, fields: dict[str, np.ndarray] | None = None) -> bytes:
    """A LAS 1.2 file of format 0 or 2, for a part of a cloud that fits a task."""
    n = len(xyz)
    kind = 2 if colour is not None else 0
    shift = np.floor(xyz.min(axis=0)) if n else np.zeros(3)
    dtype = np.dtype([("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), *FORMATS[kind]])
    p = np.zeros(n, dtype=dtype)
    for k, c in enumerate("XYZ"):
        p[c] = np.rint((xyz[:, k] - shift[k]) / scale) if n else []
    p["flags"] = 9
    for c, v in (fields or {}).items():
        p[c] = v
    if colour is not None:
        for k, c in enumerate("rgb"):
            p[c] = colour[:, k]
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes([1, 2])
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI5I", head, 104, kind, dtype.itemsize, n, n, 0, 0, 0, 0)
    struct.pack_into("<3d3d", head, 131, scale, scale, scale, *shift)
    low, high = (xyz.min(axis=0), xyz.max(axis=0)) if n else (np.zeros(3), np.zeros(3))
    struct.pack_into("<6d", head, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    return bytes(head) + p.tobytes()


def points_by_return(points: DataFrame) -> DataFrame:
    return points.where(F.col("return_number").between(1, 5)).groupBy("return_number").agg(F.count(F.lit(1)).alias("n"))
