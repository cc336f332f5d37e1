"""Survey rules: extents, footprints, control, match statistics, source views, gains, measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def core_extent(points: DataFrame, bins: int = 128, quantile: float = 0.001, fraction: float = 0.02) -> dict[str, float]:
    """The box of the dense part of a cloud: quantile box, cells dense enough, one cell around; twice.

    The driver sees four quantiles and at most bins^2 counts a round.
    """
    from terrafold.operators.raster import core_histogram

    q = points.agg(*[F.percentile_approx(c, [quantile, 1 - quantile], 100_000).alias(c) for c in "xy"]).first()
    if q["x"] is None:
        return {}
    low, high = (q["x"][0], q["y"][0]), (q["x"][1], q["y"][1])
    for _ in range(2):
        if high[0] <= low[0] or high[1] <= low[1]:
            break
        inside = points.where(F.col("x").between(low[0], high[0]) & F.col("y").between(low[1], high[1]))
        rows = sorted(core_histogram(inside, bins, low, high).collect(), key=lambda r: (-r["n"], r["bx"], r["by"]))  # bins^2 at most
        total, run, typical = sum(r["n"] for r in rows), 0, 0
        for r in rows:
            run += r["n"]
            if run * 2 >= total:
                typical = r["n"]
                break
        dense = [r for r in rows if r["n"] >= max(1.0, fraction * typical)]
        step = [(h - l) / bins for l, h in zip(low, high, strict=True)]
        bx, by = [r["bx"] for r in dense], [r["by"] for r in dense]
        low, high = (low[0] + (min(bx) - 1) * step[0], low[1] + (min(by) - 1) * step[1]), (low[0] + (max(bx) + 2) * step[0], low[1] + (max(by) + 2) * step[1])
    return {"x_min": low[0], "y_min": low[1], "x_max": high[0], "y_max": high[1]}


def footprint(r: list[Column], centre: tuple[Column, Column, Column], k: tuple, width: Column, height: Column, ground: Column) -> Column:
    """The four image corners on a level: an array of x, y; null where a ray doesn't come down."""
    from terrafold.functions.geom import rotate_back

    out = []
    for u, v in ((F.lit(0.0), F.lit(0.0)), (width, F.lit(0.0)), (width, height), (F.lit(0.0), height)):
        d = rotate_back(r, ((u - k[2]) / k[0], (v - k[3]) / k[1], F.lit(1.0)))
        s = F.when(d[2] < -1e-9, (ground - centre[2]) / d[2])
        out.append(F.struct((centre[0] + s * d[0]).alias("x"), (centre[1] + s * d[1]).alias("y")))
    return F.array(*out)


def pair_stats(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """One row: pairs by status, used ones, and the inliers' least, median and most.

    pairs: id_a, id_b, status, weak, enabled, inliers; used: id_a, id_b, shared.
    """
    verified = (F.col("status") == "done") & (F.col("inliers") > 0)
    on = F.coalesce(F.col("enabled"), F.lit(True))
    weak = F.coalesce(F.col("weak"), F.lit(False))
    joined = pairs.join(used.select("id_a", "id_b", "shared"), ["id_a", "id_b"], "left")
    good = verified & on & ~weak
    return joined.agg(F.count_if(verified).alias("verified"), F.count_if(verified & weak).alias("weak"), F.count_if(~on).alias("excluded"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "error").alias("error"), F.count_if(verified & (F.col("shared") > 0)).alias("used"), F.min(F.when(good, F.col("inliers"))).alias("least"), F.percentile(F.when(good, F.col("inliers")), 0.5).alias("median"), F.max(F.when(good, F.col("inliers"))).alias("most"))


def weakest(pairs: DataFrame, n: int = 5) -> DataFrame:
    return pairs.where("status = 'done' AND inliers > 0").orderBy("inliers", "id_a", "id_b").limit(n)


def is_control() -> Column:
    """Enabled, of role control, with finite coordinates."""
    finite = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in "xyz"])
    return F.coalesce(F.col("enabled"), F.lit(True)) & (F.col("role") == "control") & finite


def control_readiness(gcps: DataFrame, marks: DataFrame, least: int = 2) -> DataFrame:
    """One row: control points that are ready, that want marks, that want coordinates; check points."""
    n = marks.groupBy("name").agg(F.count_distinct("image_id").alias("marks"))
    joined = gcps.join(n, "name", "left").withColumn("marks", F.coalesce("marks", F.lit(0)))
    control = F.col("role") == "control"
    return joined.agg(F.count_if(is_control() & (F.col("marks") >= least)).alias("ready"), F.count_if(is_control() & (F.col("marks") < least)).alias("want_marks"), F.count_if(control & ~is_control()).alias("want_coordinates"), F.count_if(F.col("role") == "check").alias("checks"))


def one_sigma(value: Column, kind: str, vertical: bool = False) -> Column:
    """A declared accuracy as one sigma of an axis."""
    from math import log, sqrt

    factor = {"sigma": 1.0, "2sigma": 2.0, "95": 1.96, "cep95": 1.96 if vertical else sqrt(-2 * log(0.05)), "hrms": 1.0 if vertical else sqrt(2)}[kind]
    return value / factor


def mahalanobis(d: list[Column], s: list[Column], rho: Column) -> Column:
    """Normalised residual of dx, dy, dz with sigmas and the horizontal correlation."""
    a, b, c = d[0] / s[0], d[1] / s[1], d[2] / s[2]
    return F.sqrt((a * a - 2 * rho * a * b + b * b) / (1 - rho * rho) + c * c)


def source_views(observations: DataFrame, rays: DataFrame, low: float = 2.0, high: float = 60.0, most: int = 8) -> DataFrame:
    """(image_id, rank, source, shared): per photograph the ones with most shared points of fit parallax.

    observations: pt, image_id; rays: pt, image_id, dx, dy, dz (unit, to the camera).
    """
    a = observations.join(rays, ["pt", "image_id"]).select("pt", "image_id", "dx", "dy", "dz")
    b = a.select("pt", F.col("image_id").alias("source"), *[F.col(c).alias(f"{c}2") for c in ("dx", "dy", "dz")])
    cosine = F.col("dx") * F.col("dx2") + F.col("dy") * F.col("dy2") + F.col("dz") * F.col("dz2")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    shared = a.join(b, "pt").where("image_id <> source").where(angle.between(low, high)).groupBy("image_id", "source").agg(F.count(F.lit(1)).alias("shared"))
    order = Window.partitionBy("image_id").orderBy(F.desc("shared"), "source")
    return shared.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("image_id", "rank", "source", "shared")


def pair_agreement(matches: DataFrame, tracks: DataFrame, error_px: float = 4.0, share: float = 0.5, least: int = 8) -> DataFrame:
    """(id_a, id_b, n, together, split, verdict): how a pair's matches fit the tracks.

    matches: id_a, id_b, kp_a, kp_b, error; tracks: image_id, kp, pt. A match whose keypoints lie in one
    point agrees; in two points it is split; else its epipolar error tells.
    """
    of = lambda c: tracks.select(F.col("image_id").alias(f"id_{c}"), F.col("kp").alias(f"kp_{c}"), F.col("pt").alias(f"pt_{c}"))
    joined = matches.join(of("a"), ["id_a", "kp_a"], "left").join(of("b"), ["id_b", "kp_b"], "left")
    both = F.col("pt_a").isNotNull() & F.col("pt_b").isNotNull()
    same = both & (F.col("pt_a") == F.col("pt_b"))
    fits = same | (~both & (F.col("error") <= error_px))
    out = joined.groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("together"), F.count_if(both & ~same).alias("split"), F.count_if(fits).alias("_fits"))
    verdict = F.when(F.col("n") < least, "unknown").when(F.col("_fits") >= share * F.col("n"), "agrees").otherwise("conflicts")
    return out.withColumn("verdict", verdict).drop("_fits")


def mesh_distance(points: DataFrame, triangles: DataFrame, reach: float) -> DataFrame:
    """(pid, distance): exact distance to the nearest triangle within reach, else null.

    triangles: tid, x0 .. z2 (see mesh.corners). Triangles are dealt to the cells their box,
    widened by the reach, covers; a point looks into its own cell.
    """
    span = lambda c: F.explode(F.sequence(F.floor((F.least(f"{c}0", f"{c}1", f"{c}2") - reach) / (2 * reach)), F.floor((F.greatest(f"{c}0", f"{c}1", f"{c}2") + reach) / (2 * reach))))
    dealt = triangles.withColumn("cx", span("x")).withColumn("cy", span("y")).withColumn("cz", span("z"))
    own = points.select("pid", "x", "y", "z", *[F.floor(F.col(c) / (2 * reach)).alias(f"c{c}") for c in "xyz"])
    names = [f"{c}{k}" for k in range(3) for c in "xyz"]

    def solve(*columns: pd.Series) -> pd.Series:
        p, a, b, c = (np.stack([columns[3 * g + k].to_numpy(float) for k in range(3)], axis=1) for g in range(4))
        return pd.Series(point_triangle(p, a, b, c))

    # The annotations are given here: the number of columns is fixed by the call.
    solve.__annotations__ = {"return": pd.Series}
    distance = F.pandas_udf(solve, "double", functionType=200)
    near = own.join(dealt, ["cx", "cy", "cz"]).select("pid", distance("x", "y", "z", *names).alias("d"))
    best = near.where(F.col("d") <= reach).groupBy("pid").agg(F.min("d").alias("distance"))
    return points.select("pid").join(best, "pid", "left")


def point_triangle(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of points to triangles, row by row: the face where the foot is inside, else the edges."""

    def segment(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        d = e - s
        t = np.clip(((p - s) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-300), 0, 1)
        return np.linalg.norm(p - s - t[:, None] * d, axis=1)

    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    inside = size > 0
    for s, e in ((a, b), (b, c), (c, a)):
        inside &= (np.cross(e - s, p - s) * n).sum(axis=1) >= 0
    height = np.abs(((p - a) * n).sum(axis=1)) / np.maximum(size, 1e-300)
    return np.where(inside, height, np.minimum.reduce([segment(a, b), segment(b, c), segment(c, a)]))


def fit_gains(overlaps: DataFrame, images: int, prior: float = 0.1, rounds: int = 100, most: int = 5_000_000) -> dict[int, float]:
    """Log gains by image that even out brightness in overlaps: normal equations by pairs, conjugate gradient.

    overlaps: i, j, n, d (mean log brightness of i less that of j over n common points): a row a pair
    of images, so the driver solves a system as sparse as the match graph. Over `most` pairs are refused.
    """
    rows = overlaps.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} overlapping pairs")
    i, j = np.array([r["i"] for r in rows], dtype=int), np.array([r["j"] for r in rows], dtype=int)
    w, d = np.array([r["n"] for r in rows], dtype=float), np.array([r["d"] for r in rows], dtype=float)

    def apply(x: np.ndarray) -> np.ndarray:
        e = w * (x[i] - x[j])
        return np.bincount(i, e, images) - np.bincount(j, e, images) + prior * x

    x, r = np.zeros(images), -(np.bincount(i, w * d, images) - np.bincount(j, w * d, images))
    p, s = r.copy(), r @ r
    for _ in range(rounds):
        if s < 1e-20:
            break
        q = apply(p)
        step = s / (p @ q)
        x, r = x + step * p, r - step * q
        s, before = r @ r, s
        p = r + (s / before) * p
    return dict(enumerate(x.tolist()))


def polyline(points: str) -> Column:
    """Length of an array of structs x, y."""
    step = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda k: F.sqrt((F.get(points, k)["x"] - F.get(points, k - 1)["x"]) ** 2 + (F.get(points, k)["y"] - F.get(points, k - 1)["y"]) ** 2))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(step, F.lit(0.0), lambda a, b: a + b))


def shoelace(points: str) -> Column:
    """Area of a ring of structs x, y, taken about its first point."""
    n = F.size(points)
    at = lambda k, c: F.get(points, k % n)[c] - F.get(points, F.lit(0))[c]
    part = F.transform(F.sequence(F.lit(0), n - 1), lambda k: at(k, "x") * at(k + 1, "y") - at(k + 1, "x") * at(k, "y"))
    return F.when(n < 3, 0.0).otherwise(F.abs(F.aggregate(part, F.lit(0.0), lambda a, b: a + b)) / 2)


def screen_select(points: DataFrame, matrix: list[list[float]], rings: list[list[tuple[float, float]]], edge: bool = True) -> DataFrame:
    """Points whose clip-space projection lies inside a lasso (even-odd), in front of the camera.

    Edges are half-open, as in a polygon's other uses; with edge=False no point on one is selected.
    """
    from terrafold.operators.raster import inside_polygon, on_edge

    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    w = row([float(v) for v in matrix[3]])
    u, v = row([float(c) for c in matrix[0]]) / w, row([float(c) for c in matrix[1]]) / w
    inside = (w > 0) & inside_polygon(u, v, rings)
    return points.where(inside if edge else inside & ~on_edge(u, v, rings))


def classify_selection(points: DataFrame, selected: DataFrame, value: int) -> DataFrame:
    """Points with the class of the selected ones (by pid) set; the column is made where it is missing."""
    now = F.col("classification") if "classification" in points.columns else F.lit(0)
    mark = selected.select("pid").distinct().withColumn("_in", F.lit(True))
    return points.join(mark, "pid", "left").withColumn("classification", F.when(F.col("_in"), value).otherwise(now)).drop("_in")


def import_transform(points: DataFrame, unit: float = 1.0, y_up: bool = False) -> DataFrame:
    """Units to metres, and y-up to z-up: (x, y, z) becomes (x, -z, y)."""
    x, y, z = (F.col(c) * unit for c in "xyz")
    return points.withColumns({"x": x, "y": -z if y_up else y, "z": y if y_up else z})


def profile_dataset(images: DataFrame, gcps: DataFrame) -> DataFrame:
    """One row: counts, typical format, share with positions, capture span, kind."""
    i = images.agg(F.count(F.lit(1)).alias("images"), F.percentile(F.col("width") * F.col("height") / 1e6, 0.5).alias("megapixels"), F.avg(F.col("lon").isNotNull().cast("double")).alias("positioned"), (F.max("t") - F.min("t")).alias("seconds"))
    g = gcps.agg(F.count_if(F.col("role") == "control").alias("controls"), F.count_if(F.col("role") == "check").alias("checks"))
    kind = F.when(F.col("images") == 0, "empty").when(F.col("positioned") >= 0.8, "aerial").otherwise("close range")
    return i.join(F.broadcast(g)).withColumn("kind", kind)  # one row each


def fill_enclosed(cells: DataFrame) -> DataFrame:
    """(row, col, z, filled): gaps that data encloses, by a pull and push over means of 2 x 2 cells."""
    from terrafold.operators import graph
    from terrafold.operators.select import enclosed

    holes = graph.settled(enclosed(cells))
    level = graph.settled(cells.select("row", "col", "z", F.lit(1.0).alias("w")))
    stack = [level]
    while level.agg((F.max("row") - F.min("row") + F.max("col") - F.min("col"))).first()[0] and len(stack) < 24:
        half = [F.floor(F.col(c) / 2).cast("bigint").alias(c) for c in ("row", "col")]
        level = graph.settled(level.groupBy(*half).agg((F.sum(F.col("z") * F.col("w")) / F.sum("w")).alias("z"), F.least(F.lit(1.0), F.sum("w") / 4).alias("w")))
        stack.append(level)
    # A hole takes the finest level that has data around it: the weighted mean along the pyramid.
    value = holes.select("row", "col", F.lit(0.0).alias("s"), F.lit(1.0).alias("left"))
    for k, coarse in enumerate(stack[1:], 1):
        at = [F.floor(F.col(c) / 2**k).cast("bigint").alias(f"k{c}") for c in ("row", "col")]
        level = coarse.select(F.col("row").alias("krow"), F.col("col").alias("kcol"), "z", "w")
        joined = value.select("*", *at).join(level, ["krow", "kcol"], "left")
        w = F.coalesce("w", F.lit(0.0))
        value = joined.select("row", "col", (F.col("s") + F.col("left") * w * F.coalesce("z", F.lit(0.0))).alias("s"), (F.col("left") * (1 - w)).alias("left"))
    filled = value.where("left < 1").select("row", "col", (F.col("s") / (1 - F.col("left"))).alias("z"), F.lit(1).alias("filled"))
    return cells.select("row", "col", "z", F.lit(0).alias("filled")).unionByName(filled)


def warp(cells: DataFrame, target: DataFrame, inverse, gsd: float, origin_x: float, origin_y: float) -> DataFrame:
    """(row, col, z) of a target grid (row, col, x, y): heights sampled where `inverse` maps each cell.

    inverse: from columns x, y to columns in the source's frame.
    """
    from terrafold.operators.raster import sample

    u, v = inverse(F.col("x"), F.col("y"))
    places = target.select(F.struct("row", "col").alias("id"), u.alias("x"), v.alias("y"))
    return sample(cells, places, gsd, origin_x, origin_y).select("id.row", "id.col", "z")
