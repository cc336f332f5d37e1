"""Delimited text, coordinates, control points, poses, GeoJSON and grids as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.text import gcp_role

#: Patterns of header cells, in the order of precedence.
ROLES = {
    "image": r"^(image|photo|file|filename|img)",
    "name": r"^(name|label|id|point|gcp|marker|station)",
    "lon": r"^(lon|long|longitude|lng)",
    "lat": r"^(lat|latitude)",
    "x": r"^(x|east|easting|e)($|[^a-z])",
    "y": r"^(y|north|northing|n)($|[^a-z])",
    "z": r"^(z|alt|altitude|elev|elevation|height|h)($|[^a-z])",
    "px": r"^(px|pixel ?x|col|column|u)($|[^a-z])",
    "py": r"^(py|pixel ?y|row|line|v)($|[^a-z])",
    "omega": r"^(omega|o)($|[^a-z])",
    "phi": r"^(phi|p)($|[^a-z])",
    "kappa": r"^(kappa|k)($|[^a-z])",
    "yaw": r"^(yaw|heading)",
    "pitch": r"^pitch",
    "roll": r"^roll",
    "role": r"^(role|type|kind|class)",
}


def content(lines: DataFrame) -> DataFrame:
    """Trimmed lines without blanks and comments."""
    return lines.select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))


def sniff_delimiter(line: str) -> str:
    """The delimiter that gives the most columns, of tab, bar, semicolon, comma and spaces."""
    counts = {d: len(re.split(d, line.strip())) for d in ("\t", r"\|", ";", ",", r"\s+")}
    return max(counts, key=lambda d: counts[d])


def sniff_delimiters(texts: DataFrame) -> DataFrame:
    """(doc_id, delimiter) of whole texts: the most frequent of bar, semicolon and comma."""
    n = lambda c: F.length("text") - F.length(F.translate("text", c, ""))
    bars, semis, commas = n("|"), n(";"), n(",")
    return texts.select("doc_id", F.when((bars >= commas) & (bars >= semis) & (bars > 0), "|").when((semis >= commas) & (semis > 0), ";").when(commas > 0, ",").otherwise(" ").alias("delimiter"))


def guess_mapping(header: list[str]) -> dict[str, int]:
    """Role of each column by its name: a lon/lat pair beats a projected one.

    Beside an image column, bare x and y are pixels.
    """
    out: dict[str, int] = {}
    for k, cell in enumerate(h.strip().lower() for h in header):
        for role, pattern in ROLES.items():
            if role not in out and re.search(pattern, cell):
                out[role] = k
                break
    if {"lon", "lat"} <= set(out):
        out.pop("x", None)
        out.pop("y", None)
        out |= {"x": out.pop("lon"), "y": out.pop("lat")}
    if "image" in out and {"x", "y"} <= set(out) and "px" not in out and "z" not in out:
        out |= {"px": out.pop("x"), "py": out.pop("y")}
    return out


def columns(lines: DataFrame, delimiter: str, mapping: dict[str, int]) -> DataFrame:
    """The mapped cells of each content line, as text."""
    cells = F.split("value", delimiter)
    return content(lines).select(*[F.trim(F.get(cells, k)).alias(r) for r, k in mapping.items()])


def parse_xyz(lines: DataFrame) -> DataFrame:
    """Lines of three to seven numbers: x, y, z, then intensity (4, 7) and colour (6, 7)."""
    cells = F.split(F.col("value"), r"[\s,;]+")
    n = F.size(cells)
    at = lambda k: F.get(cells, k).try_cast("double")
    colour = n.isin(6, 7)
    first = F.when(n == 7, 4).otherwise(3)
    part = lambda k: F.when(colour, F.get(cells, first + k).try_cast("double").cast("int"))
    rows = content(lines).select(at(0).alias("x"), at(1).alias("y"), at(2).alias("z"), F.when(n.isin(4, 7), at(3)).alias("intensity"), part(0).alias("r"), part(1).alias("g"), part(2).alias("b"))
    return rows.where("x is not null and y is not null and z is not null")


def build_gcps(rows: DataFrame) -> DataFrame:
    """(name, role, x, y, z, marks): the first row with coordinates counts, each row may add a mark.

    rows: row, name, role, x, y, z, image, px, py; a row without a name is left out.
    """
    named = rows.where(F.col("name").isNotNull() & (F.trim("name") != ""))
    placed = F.col("x").isNotNull() & F.col("y").isNotNull()
    mark = F.when(F.col("image").isNotNull() & F.col("px").isNotNull() & F.col("py").isNotNull(), F.struct("row", "image", "px", "py"))
    first = F.min(F.when(placed, F.struct("row", "x", "y", "z"))).alias("at")
    out = named.groupBy("name").agg(first, F.min(F.struct("row", "role"))["role"].alias("role"), F.sort_array(F.collect_list(mark)).alias("marks"))
    return out.select("name", gcp_role(F.coalesce("role", F.lit(""))).alias("role"), "at.x", "at.y", "at.z", "marks")


def wide_to_long(table: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """(keys, fid, px, py): a column pair a mark becomes a row a mark."""
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("fid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")) for k, (x, y) in pairs.items()]))
    return table.select(*keys, items.alias("m")).select(*keys, "m.*").where("px is not null and py is not null")


def geojson_points(texts: DataFrame) -> DataFrame:
    """(id, k, x, y, z, properties) of the point features of FeatureCollections (texts: id, text)."""
    schema = "struct<features: array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string,string>>>>"
    parsed = texts.select("id", F.from_json("text", schema).alias("j")).select("id", F.posexplode("j.features").alias("k", "f"))
    xyz = F.from_json("f.geometry.coordinates", "array<double>")
    return parsed.where(F.col("f.geometry.type") == "Point").select("id", "k", xyz[0].alias("x"), xyz[1].alias("y"), F.get(xyz, F.lit(2)).alias("z"), F.col("f.properties").alias("properties"))


def to_geojson(points: DataFrame, properties: list[str]) -> DataFrame:
    """(value): a feature a line (newline-delimited GeoJSON)."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("x", "y", "z").alias("coordinates"))
    return points.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def to_xyz(points: DataFrame, colour: bool = True, decimals: int = 3) -> DataFrame:
    """(value): 'x y z [r g b]'."""
    cells: list[Column] = [F.format_string(f"%.{decimals}f", F.col(c).cast("double")) for c in "xyz"]
    if colour and {"r", "g", "b"} <= set(points.columns):
        cells += [F.col(c).cast("string") for c in "rgb"]
    return points.select(F.concat_ws(" ", *cells).alias("value"))


def to_ascii_grid(cells: DataFrame, width: int, nodata: float = -9999.0) -> DataFrame:
    """(row, value): a line of heights for each row, gaps filled with the no-data value.

    A task holds a row at a time, not the grid.
    """
    line = F.map_from_entries(F.collect_list(F.struct("col", F.col("z").cast("string"))))
    rows = cells.where("z is not null").groupBy("row").agg(line.alias("m"))
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(width - 1).cast("bigint")), lambda k: F.coalesce(F.element_at("m", k), F.lit(str(nodata)))))
    return rows.select("row", text.alias("value"))


def ascii_header(width: int, height: int, gsd: float, origin_x: float, origin_y: float, nodata: float = -9999.0) -> str:
    return f"ncols {width}\nnrows {height}\nxllcorner {origin_x}\nyllcorner {origin_y - height * gsd}\ncellsize {gsd}\nNODATA_value {nodata:g}\n"


def parse_ascii_grid(lines: DataFrame, skip: int = 6, nodata: float = -9999.0) -> DataFrame:
    """(row, col, z) of numbered lines (n from 0, value) of a grid."""
    cells = lines.where(F.col("n") >= skip).select((F.col("n") - skip).alias("row"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("col", "v"))
    return cells.select("row", F.col("col").cast("bigint").alias("col"), F.col("v").cast("double").alias("z")).where(F.col("z") != nodata)
