"""Surfaces by cell: meshes and planes as height grids, tiles of a mesh, and cells coloured from photographs.

A cell's centre is origin_x + (col + 0.5) gsd, origin_y - (row + 0.5) gsd.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import geom

#: How far outside a triangle a cell's centre may lie: both triangles of a shared edge cover it.
SLACK = 1e-9
#: Blocks of cells across the widest footprint of a photograph.
BLOCKS = 6


def mesh_surface(vertices: DataFrame, triangles: DataFrame, gsd: float, origin_x: float, origin_y: float, width: int, height: int) -> DataFrame:
    """(row, col, z): the highest triangle over each cell's centre, as seen from above.

    vertices: vid, x, y, z; triangles: tid, v0, v1, v2. A triangle is told to the rows it reaches
    and then to the columns of each, so no array grows with its area. Upright and degenerate
    triangles, and those with a missing vertex, cover no cell.
    """
    corner = lambda k: vertices.select(F.col("vid").alias(f"v{k}"), *[F.col(c).cast("double").alias(f"{c}{k}") for c in "xyz"])
    t = triangles.select("tid", "v0", "v1", "v2")
    for k in range(3):
        t = t.join(corner(k), f"v{k}")
    x0, y0, x1, y1, x2, y2 = (F.col(f"{c}{k}") for k in range(3) for c in "xy")
    det = (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2)
    t = t.withColumn("det", det).where(F.abs("det") > 1e-20)
    first_row = F.greatest(F.lit(0), F.ceil((origin_y - F.greatest(y0, y1, y2)) / gsd - 0.5))
    last_row = F.least(F.lit(height - 1), F.floor((origin_y - F.least(y0, y1, y2)) / gsd - 0.5))
    first_col = F.greatest(F.lit(0), F.ceil((F.least(x0, x1, x2) - origin_x) / gsd - 0.5))
    last_col = F.least(F.lit(width - 1), F.floor((F.greatest(x0, x1, x2) - origin_x) / gsd - 0.5))
    spans = t.withColumns({"r0": first_row.cast("bigint"), "r1": last_row.cast("bigint"), "c0": first_col.cast("bigint"), "c1": last_col.cast("bigint")})
    spans = spans.where("r0 <= r1 and c0 <= c1").withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    px, py = origin_x + (F.col("col") + 0.5) * gsd, origin_y - (F.col("row") + 0.5) * gsd
    l0 = ((y1 - y2) * (px - x2) + (x2 - x1) * (py - y2)) / F.col("det")
    l1 = ((y2 - y0) * (px - x2) + (x0 - x2) * (py - y2)) / F.col("det")
    weighed = spans.withColumns({"l0": l0, "l1": l1}).withColumn("l2", 1 - F.col("l0") - F.col("l1"))
    inside = weighed.where((F.col("l0") >= -SLACK) & (F.col("l1") >= -SLACK) & (F.col("l2") >= -SLACK))
    z = F.col("l0") * F.col("z0") + F.col("l1") * F.col("z1") + F.col("l2") * F.col("z2")
    return inside.groupBy("row", "col").agg(F.max(z).alias("z"))


def _plane_of(points: DataFrame) -> tuple[float, float, float, float, float, int] | None:
    """(a, b, z at the mean, mean x, mean y, n) of the least-squares plane; level where no slope is determined."""
    r = points.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"], F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz")).first()
    if r["n"] < 3:
        return None
    det = r["xx"] * r["yy"] - r["xy"] ** 2
    if abs(det) <= 1e-12 * (r["xx"] * r["yy"] + 1):
        return 0.0, 0.0, r["z"], r["x"], r["y"], r["n"]
    return (r["xz"] * r["yy"] - r["yz"] * r["xy"]) / det, (r["yz"] * r["xx"] - r["xz"] * r["xy"]) / det, r["z"], r["x"], r["y"], r["n"]


def fit_plane(points: DataFrame, robust: bool = True) -> dict[str, float] | None:
    """z = a x + b y + c with rms, n, dropped; None for under three points.

    Sums are about the mean. Robust: one more fit without points beyond 2.5 robust deviations
    (1.4826 times the median distance from the first plane), if three are left.
    """
    p = points.select(*[F.col(c).cast("double").alias(c) for c in "xyz"]).where("x is not null and y is not null and z is not null")
    first = _plane_of(p)
    if first is None:
        return None
    off = lambda f: F.col("z") - (f[0] * (F.col("x") - f[3]) + f[1] * (F.col("y") - f[4]) + f[2])
    fit = first
    if robust:
        spread = p.agg(F.percentile(F.abs(off(first)), 0.5)).first()[0]
        if spread > 0:
            again = _plane_of(p.where(F.abs(off(first)) <= 2.5 * 1.4826 * spread))
            if again is not None and again[5] < first[5]:
                fit = again
    rms = p.agg(F.sqrt(F.avg(F.pow(off(fit), F.lit(2))))).first()[0]
    return {"a": fit[0], "b": fit[1], "c": fit[2] - fit[0] * fit[3] - fit[1] * fit[4], "rms": rms, "n": fit[5], "dropped": first[5] - fit[5]}


def plane_surface(points: DataFrame, gsd: float, origin_x: float, origin_y: float, width: int, height: int, robust: bool = True) -> DataFrame:
    """(row, col, z): a plane through the points on every cell of a grid; no rows for under three points."""
    spark, fit = points.sparkSession, fit_plane(points, robust)
    if fit is None:
        return spark.createDataFrame([], "row bigint, col bigint, z double")
    cells = spark.range(width * height).select(F.floor(F.col("id") / width).alias("row"), (F.col("id") % width).alias("col"))
    x, y = origin_x + (F.col("col") + 0.5) * gsd, origin_y - (F.col("row") + 0.5) * gsd
    return cells.select("row", "col", (F.lit(fit["a"]) * x + fit["b"] * y + fit["c"]).alias("z"))


def mesh_tiles(points: DataFrame, leaf: float, target: int, overlap: int = 8, axes: tuple[str, str] = ("x", "y"), most: int = 4096) -> DataFrame:
    """(tile, a0, a1, b0, b1, samples, overlap): cores of tiles of about equal count, in cells of `leaf`.

    One axis is cut into strips at quantiles of its cells, each strip on the other axis. `samples`
    counts a core with its overlap: `overlap` cells or a twentieth of a strip, on each side. Tiles grow in
    number until each has at most `target` samples, or there are `most`.
    """
    cells = points.select(*[F.floor(F.col(c) / leaf).cast("bigint").alias(k) for c, k in zip(axes, "ab", strict=True)])
    per = cells.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    from terrafold.operators.graph import settled

    per = settled(per)
    total, low, high, low_b, high_b = per.agg(F.sum("n"), F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    schema = "tile bigint, a0 bigint, a1 bigint, b0 bigint, b1 bigint, samples bigint, overlap bigint"
    if not total:
        return points.sparkSession.createDataFrame([], schema)
    tiles = max(1, -(-total // target))
    while True:
        na = max(1, min(tiles, round((tiles * (high - low + 1) / (high_b - low_b + 1)) ** 0.5)))
        nb = max(1, -(-tiles // na))
        side = max(overlap, -(-(high - low + 1) // (20 * na)))
        strips = _cuts(per, "a", na)
        spans = []
        for a0, a1 in zip(strips, strips[1:], strict=False):
            cuts = _cuts(per.where((F.col("a") >= a0) & (F.col("a") < a1)), "b", nb)
            spans += [(a0, a1, b0, b1) for b0, b1 in zip(cuts, cuts[1:], strict=False)]
        plan = points.sparkSession.createDataFrame([(k, *s) for k, s in enumerate(spans)], "tile long, a0 long, a1 long, b0 long, b1 long")
        reach = (F.col("a") >= F.col("a0") - side) & (F.col("a") < F.col("a1") + side) & (F.col("b") >= F.col("b0") - side) & (F.col("b") < F.col("b1") + side)
        counted = per.join(F.broadcast(plan), reach).groupBy("tile", "a0", "a1", "b0", "b1").agg(F.sum("n").alias("samples"))  # at most 1.5 `most` tiles
        found = counted.withColumn("overlap", F.lit(int(side)).cast("bigint")).collect()
        if tiles >= most or max(r["samples"] for r in found) <= target:
            return points.sparkSession.createDataFrame([tuple(r) for r in found], schema)
        tiles = min(most, -(-tiles * 3 // 2))


def _cuts(per: DataFrame, axis: str, k: int) -> list[int]:
    """Bounds of k spans of about equal count, from the first cell to past the last."""
    r = per.agg(F.min(axis), F.max(axis)).first()
    if r[0] is None:
        return []
    inner = per.agg(F.percentile(axis, [i / k for i in range(1, k)], F.col("n"))).first()[0] if k > 1 else []
    return sorted({r[0], r[1] + 1, *(int(-(-v // 1)) for v in inner if r[0] < v <= r[1])})


def _seen(cells: DataFrame, photos: DataFrame) -> DataFrame:
    """Every cell with the photographs whose frame its point may lie in, with u, v and depth.

    A photograph is told to the blocks of cells that its ground footprint's box meets (photos: x0, y0,
    x1, y1 over the cells' heights), so cells and photographs meet by block. The widest box spans
    BLOCKS blocks, so none is told to more than (BLOCKS + 1)^2 of them.
    """
    side = photos.agg(F.max(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))).first()[0]
    block = side / BLOCKS if side and isfinite(side) else 256.0
    size = lambda c, k: F.floor(F.col(c) / k).cast("bigint")
    spread = lambda a, b: F.explode(F.sequence(size(a, block), size(b, block)))
    # Never broadcast: the estimate of what an explode of the photographs gives knows nothing of it.
    dealt = photos.withColumn("bx", spread("x0", "x1")).withColumn("by", spread("y0", "y1")).hint("merge")
    near = cells.withColumn("bx", size("x", block)).withColumn("by", size("y", block)).join(dealt, ["bx", "by"])
    r, t, k = [F.col(f"r{i}") for i in range(9)], tuple(F.col(f"t{i}") for i in range(3)), tuple(F.col(c) for c in ("fx", "fy", "cx", "cy"))
    u, v, depth = geom.project(r, t, k, (F.col("x"), F.col("y"), F.col("z")))
    return near.withColumns({"u": u, "v": v, "depth": depth}).where("u is not null")


#: Columns of photographs: image_id, r0..r8, t0..t2, fx, fy, cx, cy, width, height and the box x0, y0, x1, y1.
PHOTO = ["image_id", *[f"r{k}" for k in range(9)], *[f"t{k}" for k in range(3)], "fx", "fy", "cx", "cy", "width", "height", "x0", "y0", "x1", "y1"]


def sample_ortho(cells: DataFrame, photos: DataFrame, pixels: DataFrame, depth_tol: float = 0.02, max_cost: float = 0.6, blend: str = "best") -> DataFrame:
    """(row, col, r, g, b, image_id): each cell's colour from a photograph that sees it.

    cells: row, col, x, y, z; pixels: image_id, pu, pv, depth, cost, r, g, b (a depth map's pixels).
    A photograph sees a cell if its depth there is the cell's within depth_tol of it (relative)
    and was matched with a cost of at most max_cost. best: the least cost + depth / 10^6, ties to
    the smaller id. average: by 1 / (cost + 0.001), image_id null. Unseen cells are absent.
    """
    seen = _seen(cells.select("row", "col", "x", "y", "z"), photos.select(*PHOTO))
    seen = seen.withColumns({"pu": F.floor(F.col("u") + 0.5).cast("bigint"), "pv": F.floor(F.col("v") + 0.5).cast("bigint"), "away": F.col("depth")}).where("pu >= 0 and pv >= 0 and pu < width and pv < height")
    stored = pixels.select("image_id", "pu", "pv", F.col("depth").alias("stored"), "cost", "r", "g", "b").where((F.col("stored") > 0) & (F.col("cost") <= max_cost))
    # Neither side is ever broadcast: both may come of an explode, of which a plan's estimate knows nothing.
    met = seen.select("row", "col", "image_id", "pu", "pv", "away").hint("merge").join(stored.hint("merge"), ["image_id", "pu", "pv"]).where(F.abs(F.col("stored") - F.col("away")) <= depth_tol * F.col("away"))
    if blend == "average":
        w = 1 / (F.col("cost") + 1e-3)
        mean = lambda c: F.floor(F.sum(w * F.col(c)) / F.sum(w) + 0.5).cast("bigint").alias(c)
        return met.groupBy("row", "col").agg(*[mean(c) for c in "rgb"], F.lit(None).cast(dict(photos.dtypes)["image_id"]).alias("image_id"))
    best = F.min(F.struct((F.col("cost") + 1e-6 * F.col("away")).alias("score"), "image_id", "r", "g", "b")).alias("m")
    return met.groupBy("row", "col").agg(best).select("row", "col", "m.r", "m.g", "m.b", "m.image_id")


def best_captures(cells: DataFrame, photos: DataFrame, margin: float = 2.0) -> DataFrame:
    """(row, col, image_id, u, v): the photograph that sees each cell nearest to its principal point.

    The rule of a reflectance map: the most nadir view, `margin` pixels off the frame's edge; ties go
    to the smaller id. Cells that no photograph sees are absent.
    """
    seen = _seen(cells.select("row", "col", "x", "y", "z"), photos.select(*PHOTO))
    inside = seen.where((F.col("u") >= margin) & (F.col("v") >= margin) & (F.col("u") <= F.col("width") - 1 - margin) & (F.col("v") <= F.col("height") - 1 - margin))
    x, y = (F.col("u") - F.col("cx")) / F.col("fx"), (F.col("v") - F.col("cy")) / F.col("fy")
    best = F.min(F.struct((x * x + y * y).alias("score"), "image_id", "u", "v")).alias("m")
    return inside.groupBy("row", "col").agg(best).select("row", "col", "m.image_id", "m.u", "m.v")


def radiance(dn: Column, y: Column, cal: tuple[float, float, float], gain: float, exposure: float, bits: int, black: float = 0.0, factor: float = 1.0, vignette: Column | None = None) -> Column:
    """A band's radiometric model at raw row y: 0 at or below the black level."""
    a1, a2, a3 = cal
    v = dn - black
    row = 1 / (1 + (a2 * y) / exposure - a3 * y)
    scale = a1 / (gain * exposure * 2**bits) * factor
    return F.when(v > 0, (F.lit(1.0) if vignette is None else vignette) * row * v * scale).otherwise(0.0)


def fill_gaps(pixels: DataFrame, mask: DataFrame, radius: int, method: str = "idw") -> DataFrame:
    """(row, col, r, g, b, filled): small holes inside the surface, from sampled pixels alone.

    pixels: row, col, r, g, b; mask: row, col of the surface. nearest: ties go to the smaller row, then column.
    """
    own = pixels.select("row", "col", "r", "g", "b")
    holes = mask.select("row", "col").distinct().join(own.select("row", "col"), ["row", "col"], "left_anti")
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    around = holes.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumn("d2", F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).where((F.col("d2") > 0) & (F.col("d2") <= radius * radius))
    near = around.select(F.col("row").alias("hr"), F.col("col").alias("hc"), (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), "dr", "dc", "d2").join(own, ["row", "col"])
    by = near.groupBy(F.col("hr").alias("row"), F.col("hc").alias("col"))
    if method == "nearest":
        filled = by.agg(F.min(F.struct("d2", "dr", "dc", "r", "g", "b")).alias("m")).select("row", "col", "m.r", "m.g", "m.b")
    else:
        mean = lambda c: F.floor(F.sum(F.col(c) / F.col("d2")) / F.sum(1 / F.col("d2")) + 0.5).cast("bigint").alias(c)
        filled = by.agg(*[mean(c) for c in "rgb"])
    return own.withColumn("filled", F.lit(0)).unionByName(filled.withColumn("filled", F.lit(1)))
