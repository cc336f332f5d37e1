"""Raster operators: cells are rows (row, col, z), row 0 in the north, null or absent = no data."""

from __future__ import annotations

import math

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.stats import rounded, upper_median


def grid_cell(gsd: float, origin_x: float, origin_y: float, x: str = "x", y: str = "y") -> dict[str, Column]:
    return {"row": F.floor((F.lit(origin_y) - F.col(y)) / gsd).cast("bigint"), "col": F.floor((F.col(x) - origin_x) / gsd).cast("bigint")}


def rasterize(points: DataFrame, gsd: float, origin_x: float, origin_y: float, width: int, height: int, how: str = "max") -> DataFrame:
    """Points to an elevation model: max, min, mean or (upper) median of each cell.

    A point on the far right or bottom edge belongs to the last cell; others outside are left out.
    """
    right, bottom = origin_x + width * gsd, origin_y - height * gsd
    at = grid_cell(gsd, origin_x, origin_y)
    row = F.when(F.col("y") == bottom, F.lit(height - 1)).otherwise(at["row"]).cast("bigint")
    col = F.when(F.col("x") == right, F.lit(width - 1)).otherwise(at["col"]).cast("bigint")
    value = {"max": F.max("z"), "min": F.min("z"), "mean": F.avg("z"), "median": upper_median("z")}[how]
    inside = points.withColumns({"row": row, "col": col}).where((F.col("row").between(0, height - 1)) & (F.col("col").between(0, width - 1)))
    return inside.groupBy("row", "col").agg(value.alias("z"), F.count(F.lit(1)).alias("support"))


def shifted(cells: DataFrame, offsets: list[tuple[int, int]], value: str = "z") -> DataFrame:
    """(row, col, dr, dc, v): for every cell the values at the offsets around it."""
    o = F.explode(F.array(*[F.struct(F.lit(r).cast("bigint").alias("dr"), F.lit(c).cast("bigint").alias("dc")) for r, c in offsets])).alias("o")
    return cells.select("row", "col", F.col(value).alias("v"), o).select((F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o.dr", "o.dc", "v")


def all_cells(cells: DataFrame) -> DataFrame:
    """(row, col) of the whole box of the cells; rows are dealt, columns expanded in place."""
    b = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    return b.where("r0 is not null").select(F.explode(F.sequence("r0", "r1")).alias("row"), "c0", "c1").repartition("row").select("row", F.explode(F.sequence("c0", "c1")).alias("col"))


def fill_nodata(cells: DataFrame, radius: int = 2, method: str = "idw") -> DataFrame:
    """(row, col, z, filled): holes of the box from measured cells within the radius.

    idw: sum(z / d2) / sum(1 / d2). nearest: the nearest, ties in scan order of the offset.
    Holes without a measured cell near stay absent.
    """
    offsets = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if 0 < r * r + c * c <= radius * radius]
    holes = all_cells(cells).join(cells.select("row", "col"), ["row", "col"], "left_anti")
    near = shifted(cells, offsets).join(holes, ["row", "col"])
    d2 = (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).cast("double")
    value = F.sum(F.col("v") / d2) / F.sum(1.0 / d2) if method == "idw" else F.min(F.struct(d2, "dr", "dc", "v"))["v"]
    filled = near.groupBy("row", "col").agg(value.alias("z")).withColumn("filled", F.lit(1))
    return cells.select("row", "col", "z", F.lit(0).alias("filled")).unionByName(filled)


def horn(cells: DataFrame, gsd: float, z_factor: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Horn's gradient by cell: slope in degrees and percent, aspect, hillshade 1 to 255.

    A missing neighbour counts as the centre. Aspect is the bearing downhill, -1 where flat.
    """
    from math import cos, radians, sin

    offsets = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
    around = shifted(cells, offsets).groupBy("row", "col").agg(*[F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v"))).alias(f"n{r + 1}{c + 1}") for r, c in offsets])
    wide = cells.select("row", "col", "z").join(around, ["row", "col"], "left")
    n = {f"{r + 1}{c + 1}": F.coalesce(F.col(f"n{r + 1}{c + 1}"), F.col("z")) for r, c in offsets}
    s = z_factor / (8 * gsd)
    p = ((n["02"] + n["12"] * 2 + n["22"]) - (n["00"] + n["10"] * 2 + n["20"])) * s
    q = ((n["00"] + n["01"] * 2 + n["02"]) - (n["20"] + n["21"] * 2 + n["22"])) * s
    steep = F.sqrt(F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    turn = F.degrees(F.atan2(-F.col("p"), -F.col("q")))
    az, alt = radians(azimuth), radians(altitude)
    light = (F.lit(sin(alt)) - (F.col("p") * sin(az) + F.col("q") * cos(az)) * cos(alt)) / F.sqrt(1 + F.col("p") * F.col("p") + F.col("q") * F.col("q"))
    out = wide.select("row", "col", "z", p.alias("p"), q.alias("q"))
    return out.select("row", "col", "z", F.degrees(F.atan(steep)).alias("slope"), (steep * 100).alias("slope_percent"), F.when((F.col("p") == 0) & (F.col("q") == 0), F.lit(-1.0)).otherwise(F.when(turn < 0, turn + 360).otherwise(turn)).alias("aspect"), F.greatest(F.lit(1), rounded(1 + 254 * F.greatest(F.lit(0.0), light)).cast("bigint")).alias("shade"))


def sample(cells: DataFrame, places: DataFrame, gsd: float, origin_x: float, origin_y: float, strict: bool = False) -> DataFrame:
    """places (id, x, y) with z: bilinear where all four cells have data, else the nearest cell,
    else the first of the four that has data, else null. strict: the own cell must have data.
    """
    fc, fr = (F.col("x") - origin_x) / gsd - 0.5, (F.lit(origin_y) - F.col("y")) / gsd - 0.5
    base = places.select("id", "x", "y", fc.alias("fc"), fr.alias("fr")).withColumns({"c0": F.floor("fc").cast("bigint"), "r0": F.floor("fr").cast("bigint")})
    four = F.explode(F.array(*[F.struct(F.lit(r).cast("bigint").alias("dr"), F.lit(c).cast("bigint").alias("dc")) for r in (0, 1) for c in (0, 1)]))
    keyed = base.withColumn("o", four).withColumns({"row": F.col("r0") + F.col("o.dr"), "col": F.col("c0") + F.col("o.dc")})
    found = keyed.join(cells.select("row", "col", "z"), ["row", "col"], "left")
    v = {k: F.max(F.when((F.col("o.dr") == k[0]) & (F.col("o.dc") == k[1]), F.col("z"))).alias(f"v{k[0]}{k[1]}") for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    wide = found.groupBy("id", "x", "y", "fc", "fr", "r0", "c0").agg(*v.values())
    tx, ty = F.col("fc") - F.col("c0"), F.col("fr") - F.col("r0")
    bilinear = (F.col("v00") * (1 - tx) + F.col("v01") * tx) * (1 - ty) + (F.col("v10") * (1 - tx) + F.col("v11") * tx) * ty
    own = reduce(lambda acc, k: F.when((rounded(tx) == k[1]) & (rounded(ty) == k[0]), F.col(f"v{k[0]}{k[1]}")).otherwise(acc), list(v), F.lit(None).cast("double"))
    anyone = F.coalesce("v00", "v01", "v10", "v11")
    z = F.coalesce(bilinear, own) if strict else F.coalesce(bilinear, own, anyone)
    return wide.select("id", (F.when(own.isNotNull(), z) if strict else z).alias("z"))


def overview(cells: DataFrame, levels: int, value: str = "z") -> DataFrame:
    """(level, row, col, value): each level means the data of 2 x 2 cells of the one below."""
    out, now = [], cells.select("row", "col", F.col(value).alias("value"))
    for level in range(levels + 1):
        out.append(now.select(F.lit(level).alias("level"), "row", "col", "value"))
        now = now.groupBy(F.floor(F.col("row") / 2).cast("bigint").alias("row"), F.floor(F.col("col") / 2).cast("bigint").alias("col")).agg(F.avg("value").alias("value"))
    return reduce(DataFrame.unionByName, out)


def support_overview(cells: DataFrame, scale: int) -> DataFrame:
    """Share of measured cells of each block of scale x scale, 0 to 255."""
    block = [F.floor(F.col(c) / scale).cast("bigint").alias(c) for c in ("row", "col")]
    return cells.groupBy(*block).agg(rounded(F.count(F.lit(1)) * 255.0 / (scale * scale)).cast("bigint").alias("support"))


def inside_polygon(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Even-odd rule over all rings, half-open edges."""
    crossings = F.lit(0)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y1 == y2:
                continue
            hit = ((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < (y - y1) * ((x2 - x1) / (y2 - y1)) + x1)
            crossings = crossings + F.when(hit, 1).otherwise(0)
    return crossings % 2 == 1


def on_edge(x: Column, y: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a place lies on an edge of any ring, its ends included."""
    on = F.lit(False)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            line = (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1)
            on = on | (line & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    return on


def centre(gsd: float, origin_x: float, origin_y: float) -> tuple[Column, Column]:
    return F.lit(origin_x) + (F.col("col") + 0.5) * gsd, F.lit(origin_y) - (F.col("row") + 0.5) * gsd


def volume(cells: DataFrame, gsd: float, origin_x: float, origin_y: float, rings: list[list[tuple[float, float]]], base: float) -> DataFrame:
    """One row: cut above and fill below a level inside a polygon, net, and the cells measured."""
    x, y = centre(gsd, origin_x, origin_y)
    dz = F.col("z") - base
    inside = cells.where(inside_polygon(x, y, rings))
    area = gsd * gsd
    return inside.agg((F.sum(F.greatest(dz, F.lit(0.0))) * area).alias("cut"), (F.sum(F.greatest(-dz, F.lit(0.0))) * area).alias("fill"), (F.sum(dz) * area).alias("net"), F.count("z").alias("measured"))


def profile(cells: DataFrame, line: list[tuple[float, float]], step: float, gsd: float, origin_x: float, origin_y: float, most: int = 4096) -> DataFrame:
    """(id, distance, z) along a polyline; null over holes.

    Each segment is parted evenly, by `step` at most. A line of over `most` places gets a wider
    spacing, so that the whole of it is covered.
    """
    spark = cells.sparkSession
    sizes = [math.dist(a, b) for a, b in zip(line, line[1:], strict=False)]
    spacing = max(step, sum(sizes) / max(1, most - len(line)))
    places, distance = [(0, 0.0, float(line[0][0]), float(line[0][1]))], 0.0
    for (ax, ay), (bx, by), size in zip(line, line[1:], sizes, strict=False):
        n = max(1, math.ceil(size / spacing)) if size else 0
        places += [(len(places) + k - 1, distance + size * k / n, ax + (bx - ax) * k / n, ay + (by - ay) * k / n) for k in range(1, n + 1)]
        distance += size
    along = spark.createDataFrame(places, "id long, distance double, x double, y double")  # `most` rows
    own = (F.floor((F.lit(origin_y) - F.col("y")) / gsd).cast("long").alias("row"), F.floor((F.col("x") - origin_x) / gsd).cast("long").alias("col"))
    held = along.select("id", *own).join(cells.select("row", "col"), ["row", "col"], "left_semi").select("id")
    heights = sample(cells, along.select("id", "x", "y"), gsd, origin_x, origin_y).join(held, "id", "left_semi")
    return along.select("id", "distance").join(heights, "id", "left")


def compare(cells: DataFrame, reference: DataFrame) -> DataFrame:
    """(row, col, dz): differences to a reference on the same grid; null where it has no data."""
    return cells.select("row", "col", "z").join(reference.select("row", "col", F.col("z").alias("ref")), ["row", "col"], "left").select("row", "col", (F.col("z") - F.col("ref")).alias("dz"))


def despike(cells: DataFrame, threshold: float) -> DataFrame:
    """Raises cells that are alone in lying far below their neighbours to the neighbours' median.

    At least five measured neighbours, at most one of them about as low.
    """
    offsets = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r, c) != (0, 0)]
    around = shifted(cells, offsets).join(cells.select("row", "col", "z"), ["row", "col"])
    judged = around.groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"), F.percentile("v", 0.5).alias("m"), F.count_if(F.col("v") < F.col("z") + threshold).alias("low"))
    dip = (F.col("n") >= 5) & (F.col("low") <= 1) & (F.col("m") - F.col("z") > threshold)
    return cells.select("row", "col", "z").join(judged, ["row", "col"], "left").select("row", "col", F.when(dip, F.col("m")).otherwise(F.col("z")).alias("z"))


def smooth(cells: DataFrame, sigma: float) -> DataFrame:
    """Gaussian mean over the cells with data within three sigma."""
    from math import ceil

    r = max(1, ceil(3 * sigma))
    offsets = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1)]
    weight = F.exp(-(F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")) / (2.0 * sigma * sigma))
    near = shifted(cells, offsets).join(cells.select("row", "col"), ["row", "col"], "left_semi")
    return near.groupBy("row", "col").agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("z"))


def contour_crossings(cells: DataFrame, interval: float) -> DataFrame:
    """Marching squares: (row, col, level, mask) of each 2 x 2 block that a level crosses.

    Bits of mask: 1 north-west, 2 north-east, 4 south-east, 8 south-west at or above the level.
    Blocks with a cell without data are left out.
    """
    corners = shifted(cells, [(0, 0), (0, 1), (1, 0), (1, 1)]).groupBy("row", "col").agg(*[F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v"))).alias(f"v{r}{c}") for r in (0, 1) for c in (0, 1)])
    whole = corners.where("v00 is not null and v01 is not null and v10 is not null and v11 is not null")
    low, high = F.least("v00", "v01", "v10", "v11"), F.greatest("v00", "v01", "v10", "v11")
    first, last = F.floor(low / interval) + 1, F.floor(high / interval)
    levels = whole.where(last >= first).withColumn("k", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint")))).withColumn("level", F.col("k") * F.lit(interval))
    bit = lambda c, v: F.when(F.col(c) >= F.col("level"), v).otherwise(0)
    return levels.select("row", "col", "level", (bit("v00", 1) + bit("v01", 2) + bit("v11", 4) + bit("v10", 8)).alias("mask"))


def core_histogram(points: DataFrame, bins: int, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """(bx, by, n): counts over a square of bins of the box."""
    at = lambda c, a, b: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((F.col(c) - a) / ((b - a) / bins)))).cast("bigint")
    return points.groupBy(at("x", low[0], high[0]).alias("bx"), at("y", low[1], high[1]).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def dense_cells(histogram: DataFrame, fraction: float = 0.02) -> DataFrame:
    """Cells of at least `fraction` of the point-weighted median count (bins are few: bins^2)."""
    order = Window.orderBy(F.desc("n"), "bx", "by")
    ranked = histogram.withColumn("run", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    typical = ranked.where("run * 2 >= total").agg(F.max("n").alias("typical"))
    return histogram.join(F.broadcast(typical)).where(F.col("n") >= F.greatest(F.lit(1.0), F.col("typical") * fraction)).drop("typical")
