"""Files of other programs: keypoints and matches as text or JSON, and Metashape XML.

Files are rows (path, content); each is parsed by the task that reads it, and what it holds
comes out as rows of one schema. A file that can't be read gives one row of kind `error` with the reason.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Names of columns, in lower case without separators. a and b are the two images of a pair.
HEADERS = {
    "image": ["image", "name", "filename", "file", "photo", "label"],
    "x": ["x", "u", "px", "col", "xpx"],
    "y": ["y", "v", "py", "row", "ypx"],
    "scale": ["scale", "size", "sigma"],
    "angle": ["angle", "orientation", "ori", "theta"],
    "image_a": ["imagea", "image1", "namea", "name1", "lefimage", "imageleft", "from", "photoa", "photo1"],
    "image_b": ["imageb", "image2", "nameb", "name2", "rightimage", "imageright", "to", "photob", "photo2"],
    "ka": ["indexa", "index1", "idxa", "idx1", "kpa", "kp1", "keypointa", "keypoint1", "featurea", "feature1"],
    "kb": ["indexb", "index2", "idxb", "idx2", "kpb", "kp2", "keypointb", "keypoint2", "featureb", "feature2"],
    "xa": ["xa", "x1"],
    "ya": ["ya", "y1"],
    "xb": ["xb", "x2"],
    "yb": ["yb", "y2"],
}
FEATURES = "path string, kind string, image_a string, image_b string, k bigint, ka bigint, kb bigint, xa double, ya double, xb double, yb double, scale double, angle double, error string"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def _parsed(files: DataFrame, schema: str, parse: Callable[[str, str], list[dict]], errors: tuple, reason: str) -> DataFrame:
    """Rows of every file, or one of kind `error` with the reason in that column."""
    own = pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")])

    def run(batches):
        for b in batches:
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    out = [{"path": path, **r} for r in parse(text or "", path or "")]
                except errors as e:
                    out = [{"path": path, "kind": "error", reason: str(e)}]
                yield pa.RecordBatch.from_pylist(out, schema=own)

    return files.select("path", F.col("content").cast("string").alias("content")).mapInArrow(run, schema)


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def _float(v) -> float | None:
    return None if v is None else float(v)


def _lowe(text: str, image: str) -> list[dict]:
    """Lowe's key file: 'N 128', then y x scale angle and N whole numbers each, over any lines."""
    values = [float(v) for v in text.split()]
    if len(values) < 2:
        raise ValueError("no header")
    n, size = int(values[0]), int(values[1])
    if len(values) != 2 + n * (4 + size):
        raise ValueError(f"{n} keypoints of {size} values announced, other numbers found")
    out = []
    for k in range(n):
        y, x, scale, angle = values[2 + k * (4 + size) : 6 + k * (4 + size)]
        out.append({"kind": "keypoints", "image_a": image, "k": k, "xa": x, "ya": y, "scale": scale, "angle": angle})
    return out


def _from_json(text: str) -> list[dict]:
    entries = json.loads(text.removeprefix("﻿"))
    if not isinstance(entries, list) or not entries:
        raise ValueError("a list of images or of pairs is expected")
    out = []
    for n, e in enumerate(entries):
        if isinstance(e.get("keypoints"), list):
            for k, p in enumerate(e["keypoints"]):
                out.append({"kind": "keypoints", "image_a": e["image"], "k": k, "xa": float(p["x"]), "ya": float(p["y"]), "scale": _float(p.get("scale")), "angle": _float(p.get("angle", p.get("orientation")))})
        elif isinstance(e.get("matches"), list):
            for m in e["matches"]:
                if len(m) < 2 or any(not isinstance(v, int) or v < 0 for v in m[:2]):
                    raise ValueError(f"entry {n + 1}: two numbers of keypoints are expected")
                out.append({"kind": "matches", "image_a": e["imageA"], "image_b": e["imageB"], "ka": m[0], "kb": m[1]})
        elif not {"imageA", "imageB"} <= set(e):
            raise ValueError(f"entry {n + 1}: neither keypoints nor matches")
    return out


def _split(line: str) -> list[str]:
    for mark in (";", "\t", ","):
        if mark in line:
            return [v.strip().strip('"') for v in line.split(mark)]
    return line.split()


def _table(lines: list[str], image: str) -> list[dict]:
    """Rows with a header, or of a shape that says what they are."""
    rows = [_split(v) for v in lines]
    numeric = lambda r: "".join("n" if _number(v) is not None else "s" for v in r)
    first = numeric(rows[0])
    if "n" not in first:
        plain = [re.sub(r"[\s_.-]+", "", v).lower() for v in rows[0]]
        at = {c: next(plain.index(n) for n in names if n in plain) for c, names in HEADERS.items() if any(n in plain for n in names)}
        rows = rows[1:]
        if not rows:
            raise ValueError("a header without rows")
    else:
        shapes = {"ssnn": ["image_a", "image_b", "ka", "kb"], "snnsnn": ["image_a", "xa", "ya", "image_b", "xb", "yb"]}
        shapes |= {p + "nn" + "n" * k: (["image"] if p else []) + ["x", "y", *["scale", "angle"][:k]] for p in ("", "s") for k in range(3)}
        if first not in shapes:
            raise ValueError("neither keypoints (x y) nor matches (image image number number)")
        at = {c: k for k, c in enumerate(shapes[first])}
    get = lambda r, c: r[at[c]] if c in at and at[c] < len(r) else None
    value = lambda r, c: None if get(r, c) in (None, "") else float(get(r, c))
    if {"image_a", "image_b"} <= set(at):
        if {"xa", "ya", "xb", "yb"} <= set(at):
            return [{"kind": "point-matches", "image_a": get(r, "image_a"), "image_b": get(r, "image_b"), **{c: value(r, c) for c in ("xa", "ya", "xb", "yb")}} for r in rows]
        if {"ka", "kb"} <= set(at):
            return [{"kind": "matches", "image_a": get(r, "image_a"), "image_b": get(r, "image_b"), "ka": int(value(r, "ka")), "kb": int(value(r, "kb"))} for r in rows]
        raise ValueError("two images, but neither numbers nor places of keypoints")
    if not {"x", "y"} <= set(at):
        raise ValueError("no columns of places")
    out, seen = [], {}
    for r in rows:
        name = get(r, "image") or image
        seen[name] = seen.get(name, -1) + 1
        out.append({"kind": "keypoints", "image_a": name, "k": seen[name], "xa": value(r, "x"), "ya": value(r, "y"), "scale": value(r, "scale"), "angle": value(r, "angle")})
    return out


def _blocks(lines: list[str]) -> list[dict]:
    """Two names, then pairs of numbers, until the next two names."""
    out, pair = [], None
    for line in lines:
        a, b = _split(line)
        if _number(a) is None:
            pair = (a, b)
        else:
            out.append({"kind": "matches", "image_a": pair[0], "image_b": pair[1], "ka": int(a), "kb": int(b)})
    return out


def feature_rows(text: str, path: str) -> list[dict]:
    """What a file of keypoints or matches holds. Lines that start with # or // are comments."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    image = name.rsplit(".", 1)[0]
    if name.lower().endswith(".key"):
        return _lowe(text, image)
    if name.lower().endswith(".json") or text.removeprefix("﻿").lstrip()[:1] in ("[", "{"):
        return _from_json(text)
    lines = [v for v in text.removeprefix("﻿").splitlines() if v.strip() and not v.lstrip().startswith(("#", "//"))]
    if not lines:
        raise ValueError("the file is empty")
    head, after = _split(lines[0]), _split(lines[1]) if len(lines) > 1 else []
    if len(head) == 2 and all(_number(v) is not None for v in head) and len(after) == 4 and float(head[1]) >= 16:
        return _lowe(text, image)
    named = len(head) == 2 and all(_number(v) is None for v in head) and not {v.lower() for v in head} <= {"x", "y", "u", "v"}
    if named and len(after) == 2 and all(_number(v) is not None for v in after):
        return _blocks(lines)
    return _table(lines, image)


def read_features(files: DataFrame) -> DataFrame:
    """files: path, content (text or bytes). A row a keypoint or match; see FEATURES."""
    return _parsed(files, FEATURES, feature_rows, (ValueError, KeyError, TypeError, AttributeError), "error")


def keypoints_of_points(points: DataFrame, digits: int = 2) -> tuple[DataFrame, DataFrame]:
    """Keypoints (image, kp, x, y) and matches (image_a, image_b, ka, kb) of matched places.

    points: image_a, xa, ya, image_b, xb, yb. A keypoint is a place to 1/100 pixel, so a place
    matched in several pairs is one; they are numbered by place, with the least coordinates of each.
    """
    at = lambda c: F.floor(F.col(c) * 10**digits + 0.5).cast("bigint")
    keyed = points.select("image_a", "image_b", *[F.col(c) for c in ("xa", "ya", "xb", "yb")], *[at(c).alias(f"i{c}") for c in ("xa", "ya", "xb", "yb")])
    side = lambda c: keyed.select(F.col(f"image_{c}").alias("image"), F.col(f"ix{c}").alias("ix"), F.col(f"iy{c}").alias("iy"), F.col(f"x{c}").alias("x"), F.col(f"y{c}").alias("y"))
    places = side("a").unionByName(side("b")).groupBy("image", "ix", "iy").agg(F.min(F.struct("x", "y")).alias("p"))
    order = Window.partitionBy("image").orderBy("iy", "ix")
    numbered = places.withColumn("kp", (F.row_number().over(order) - 1).cast("bigint"))
    of = lambda c: numbered.select(F.col("image").alias(f"image_{c}"), F.col("ix").alias(f"ix{c}"), F.col("iy").alias(f"iy{c}"), F.col("kp").alias(f"k{c}"))
    matches = keyed.join(of("a"), ["image_a", "ixa", "iya"]).join(of("b"), ["image_b", "ixb", "iyb"]).select("image_a", "image_b", "ka", "kb").distinct()
    return numbered.select("image", "kp", "p.x", "p.y"), matches


METASHAPE = "path string, chunk string, kind string, id string, label string, sensor_id string, enabled boolean, x double, y double, z double, accuracy double, values array<double>, detail string"


def _numbers(e) -> list[float] | None:
    return None if e is None or not (e.text or "").strip() else [float(v) for v in e.text.split()]


def _yes(v: str | None) -> bool:
    return (v or "true").lower() in ("1", "true", "yes")


def _reference(e) -> dict:
    ref = e.find("reference")
    if ref is None:
        return {}
    get = lambda k: None if ref.get(k) is None else float(ref.get(k))
    return {"x": get("x"), "y": get("y"), "z": get("z"), "accuracy": get("accuracy")}


def metashape_rows(text: str) -> list[dict]:
    """Sensors, cameras, markers with their places on photographs, scale bars and transforms of every chunk."""
    root = ET.fromstring(text)
    if root.tag != "document":
        raise ValueError("no <document>")
    chunks = [*root.findall("chunk"), *root.findall("chunks/chunk")]
    if not chunks:
        raise ValueError("no chunk")
    out = []
    for c in chunks:
        own = {"chunk": c.get("label", "Chunk")}
        crs = c.find("reference")
        move = c.find("transform")
        if move is not None:
            scale = _numbers(move.find("scale")) or [1.0]
            out.append(own | {"kind": "transform", "values": (_numbers(move.find("rotation")) or [1, 0, 0, 0, 1, 0, 0, 0, 1]) + (_numbers(move.find("translation")) or [0, 0, 0]) + scale[:1], "detail": None if crs is None else crs.text})
        for s in c.findall("sensors/sensor"):
            size, lens = s.find("resolution"), s.find("calibration")
            terms = {} if lens is None else {k.tag: float(k.text) for k in lens if k.tag != "resolution" and _is_number(k.text)}
            out.append(own | {"kind": "sensor", "id": s.get("id"), "label": s.get("label"), "x": None if size is None else float(size.get("width")), "y": None if size is None else float(size.get("height")), "detail": json.dumps({"type": s.get("type"), **terms}, sort_keys=True)})
        for p in c.iterfind("cameras//camera"):
            out.append(own | {"kind": "camera", "id": p.get("id"), "label": p.get("label", ""), "sensor_id": p.get("sensor_id"), "enabled": _yes(p.get("enabled")), "values": _numbers(p.find("transform")), **_reference(p)})
        for m in c.findall("markers/marker"):
            out.append(own | {"kind": "marker", "id": m.get("id"), "label": m.get("label", f"point {m.get('id')}"), "enabled": m.find("reference") is not None and _yes(m.find("reference").get("enabled")), **_reference(m)})
        for m in c.findall("frames/frame/markers/marker"):
            for at in m.findall("location"):
                out.append(own | {"kind": "mark", "id": m.get("marker_id"), "label": at.get("camera_id"), "x": float(at.get("x")), "y": float(at.get("y")), "enabled": _yes(at.get("pinned"))})
        for b in c.findall("scalebars/scalebar"):
            ends = [e.get("marker_id") or e.get("camera_id") for e in b.findall("endpoint")]
            ref = b.find("reference")
            out.append(own | {"kind": "scalebar", "id": b.get("id"), "label": b.get("label", f"scalebar {b.get('id')}"), "x": None if ref is None or ref.get("d") is None else float(ref.get("d")), "accuracy": None if ref is None or ref.get("accuracy") is None else float(ref.get("accuracy")), "enabled": ref is not None and _yes(ref.get("enabled")), "detail": json.dumps(ends)})
    return out


def _is_number(text: str | None) -> bool:
    return text is not None and _number(text) is not None


def read_metashape(files: DataFrame) -> DataFrame:
    """files: path, content (an XML file). See METASHAPE; kinds: transform, sensor, camera, marker, mark, scalebar, error."""
    return _parsed(files, METASHAPE, lambda text, path: metashape_rows(text), (ValueError, TypeError, ET.ParseError), "detail")
