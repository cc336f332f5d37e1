"""Ranked and greedy selections, joins of files and projects, depth maps, and other small rules."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.match import basename, stem


def suppress(keypoints: DataFrame, radius: float, by: str = "image_id") -> DataFrame:
    """Keypoints that no stronger kept one lies nearer to than the radius; only across tiles.

    keypoints: image_id, kp, tile, x, y, scale, response. The strongest goes first, ties to the
    smaller number; siblings (same place and scale) stay together. One image is one task.
    """
    kinds = dict(keypoints.dtypes)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["response", "kp"], ascending=[False, True], kind="stable")
        cells: dict[tuple[int, int], list[tuple]] = {}
        kept = []
        for row in zip(pdf["x"], pdf["y"], pdf["scale"], pdf["tile"], pdf["kp"], strict=True):
            x, y, scale, tile, kp = row
            cx, cy = int(x // radius), int(y // radius)
            near = (o for i in (-1, 0, 1) for j in (-1, 0, 1) for o in cells.get((cx + i, cy + j), ()))
            if all(o[3] == tile or o[:3] == (x, y, scale) or (o[0] - x) ** 2 + (o[1] - y) ** 2 >= radius * radius for o in near):
                cells.setdefault((cx, cy), []).append(row)
                kept.append(kp)
        return pd.DataFrame({by: pdf[by].iloc[0], "kp": kept})

    return keypoints.groupBy(by).applyInPandas(greedy, f"{by} {kinds[by]}, kp {kinds['kp']}")


def spread(candidates: DataFrame, width: float, height: float, limit: int = 30, separation: float = 24.0, by: str = "image_id") -> DataFrame:
    """The best candidate of each cell of a root-limit grid at a distance, then others up to the limit.

    candidates: image_id, id, x, y, confidence.
    """
    kinds = dict(candidates.dtypes)
    n = max(1, int(np.floor(np.sqrt(limit))))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["confidence", "id"], ascending=[False, True], kind="stable")
        rows = list(zip(pdf["id"], pdf["x"], pdf["y"], strict=True))
        taken: list[tuple] = []
        cells = set()
        apart = lambda x, y: all((x - a) ** 2 + (y - b) ** 2 >= separation**2 for _, a, b in taken)
        for first in (True, False):
            for k, x, y in rows:
                cell = (min(n - 1, int(x * n / width)), min(n - 1, int(y * n / height)))
                if len(taken) < limit and (k, x, y) not in taken and apart(x, y) and not (first and cell in cells):
                    taken.append((k, x, y))
                    cells.add(cell)
        return pd.DataFrame({by: pdf[by].iloc[0], "id": [k for k, _, _ in taken]})

    return candidates.groupBy(by).applyInPandas(greedy, f"{by} {kinds[by]}, id {kinds['id']}")


def reduce_overlap(visibility: DataFrame, coverage: int = 3, most: int = 10_000_000) -> DataFrame:
    """(image_id) of photographs that may go while each point keeps min(coverage, seen) views.

    visibility: pt, image_id (a bounded sample of points). A photograph whose points all have
    views to spare goes, the most redundant first; greedy, so it runs in one task, and over
    `most` rows are refused.
    """
    if visibility.limit(most + 1).count() > most:
        raise ValueError(f"over {most} views: sample the points first")
    kind = dict(visibility.dtypes)["image_id"]

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        images, points = np.unique(pdf["image_id"]), np.unique(pdf["pt"])
        i, p = np.searchsorted(images, pdf["image_id"]), np.searchsorted(points, pdf["pt"])
        seen = np.bincount(p, minlength=len(points))
        need = np.minimum(seen, coverage)
        own = [p[i == k] for k in range(len(images))]
        left, gone = set(range(len(images))), []
        while left:
            spare = {k: (seen[own[k]] - need[own[k]]).min(initial=10**9) for k in left}
            free = [k for k in left if spare[k] > 0]
            if not free:
                break
            k = max(free, key=lambda k: (float((seen[own[k]] - need[own[k]]).mean()) if len(own[k]) else 1e9, -k))
            seen[own[k]] -= 1
            left.discard(k)
            gone.append(images[k])
        return pd.DataFrame({"image_id": gone})

    return visibility.select("pt", "image_id").distinct().withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(greedy, f"image_id {kind}")


def canonical_siblings(keypoints: DataFrame) -> DataFrame:
    """(image_id, kp, canonical): keypoints of the same place and scale take the smallest number."""
    first = keypoints.groupBy("image_id", "x", "y", "scale").agg(F.min("kp").alias("canonical"))
    return keypoints.join(first, ["image_id", "x", "y", "scale"]).select("image_id", "kp", "canonical")


def moving_matches(matches: DataFrame, tol: float) -> DataFrame:
    """Matches that move farther than tol pixels (xa, ya, xb, yb)."""
    return matches.where((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2 > tol * tol)


def valid_matches(matches: DataFrame, counts: DataFrame) -> DataFrame:
    """Matches whose keypoints exist (counts: image_id, n)."""
    n = lambda c: counts.select(F.col("image_id").alias(f"id_{c}"), F.col("n").alias(f"n_{c}"))
    return matches.join(n("a"), "id_a").join(n("b"), "id_b").where((F.col("kp_a") >= 0) & (F.col("kp_b") >= 0) & (F.col("kp_a") < F.col("n_a")) & (F.col("kp_b") < F.col("n_b"))).drop("n_a", "n_b")


def filter_tracks(observations: DataFrame, gate: float, min_angle: float) -> DataFrame:
    """Drops observations behind the camera or over the gate, then points of too few views or parallax.

    observations: pt, image_id, error, depth, dx, dy, dz (unit ray from the point to the camera).
    """
    good = observations.where((F.col("depth") > 0) & (F.col("error") <= gate))
    a = good.select("pt", "image_id", "dx", "dy", "dz")
    b = good.select("pt", F.col("image_id").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("dx", "dy", "dz")])
    cosine = F.col("dx") * F.col("dx2") + F.col("dy") * F.col("dy2") + F.col("dz") * F.col("dz2")
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    wide = a.join(b, "pt").where("image_id < other").groupBy("pt").agg(F.max(angle).alias("angle")).where(F.col("angle") >= min_angle)
    return good.join(wide, "pt", "left_semi")


def select_sparse(metrics: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Points to drop: error over, or track length or angle under the threshold; NaN never."""
    v = F.col(metric)
    test = v > threshold if metric == "error" else v < threshold
    return metrics.where(v.isNotNull() & ~F.isnan(v.cast("double")) & test)


def registration_outliers(pairs: DataFrame, factor: float = 3.0, min_px: float = 2.0, top: int = 5) -> DataFrame:
    """(image_id, error, flagged): upper median over each camera's strongest pairs of their median error.

    pairs: id_a, id_b, inliers, median_px. Flagged above max(factor times the upper median of cameras, min_px).
    """
    from terrafold.functions.stats import upper_median

    ends = pairs.select(F.col("id_a").alias("image_id"), "inliers", F.col("id_b").alias("o"), "median_px").unionByName(pairs.select(F.col("id_b").alias("image_id"), "inliers", F.col("id_a").alias("o"), "median_px"))
    order = Window.partitionBy("image_id").orderBy(F.desc("inliers"), "o")
    own = ends.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top).groupBy("image_id").agg(upper_median("median_px").alias("error"))
    typical = own.agg(upper_median("error").alias("typical"))  # one row
    return own.join(F.broadcast(typical)).select("image_id", "error", (F.col("error") > F.greatest(F.col("typical") * factor, F.lit(min_px))).alias("flagged"))


def mask_files(files: DataFrame, images: DataFrame) -> DataFrame:
    """(key, file): for each image the mask file of the best candidate name, earlier files on ties.

    files: ord, file; images: ord, key, name. Candidates of a file: its own name, the name under
    a trailing .png (image.jpg.png), the name without a _mask suffix; a later kind wins. Each
    goes through the four tiers of the name join.
    """
    from terrafold.operators.match import resolve_names

    own = F.col("file")
    kinds = [own, F.regexp_replace(own, r"\.png$", ""), F.regexp_replace(own, r"[_-]mask(\.[^.]*)?$", "$1")]
    asked = files.select("ord", "file", F.posexplode(F.array(*kinds)).alias("kind", "name")).where((F.col("kind") == 0) | (F.col("name") != F.col("file")))
    named = resolve_names(images, asked.select("name"))
    met = asked.join(named, "name").where("key is not null")
    return met.groupBy("key").agg(F.min(F.struct((-F.col("kind")).alias("kind"), "ord", "file")).alias("m")).select("key", F.col("m.file").alias("file"))


def merge_projects(target: DataFrame, source: DataFrame) -> DataFrame:
    """(uuid, matched, label): source photographs by (name, size, width, height), else by uuid, else added.

    target, source: uuid, name, size, width, height. An added name that is taken gets ' (2)' and so on.
    """
    key = ["name", "size", "width", "height"]
    first = target.groupBy(*key).agg(F.min("uuid").alias("by_key"))
    met = source.join(first, key, "left").join(target.select("uuid", F.col("uuid").alias("by_uuid")).distinct(), "uuid", "left")
    out = met.withColumn("matched", F.coalesce("by_key", "by_uuid"))
    taken = target.groupBy("name").agg(F.count(F.lit(1)).alias("taken"))
    order = Window.partitionBy("name", F.col("matched").isNull()).orderBy("uuid")
    added = out.join(taken, "name", "left").withColumn("n", F.coalesce("taken", F.lit(0)) + F.row_number().over(order))
    from terrafold.functions.text import numbered

    return added.select("uuid", "matched", F.when(F.col("matched").isNull(), numbered(F.col("name"), F.col("n"))).otherwise(F.col("name")).alias("label"))


def sensor_groups(images: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(image_id, sensor): images of one signature and of about the same format share a sensor.

    images: image_id, make, model, focal, width, height. The first image of a group names it;
    formats count as equal within the tolerance of a logarithmic step.
    """
    step = lambda c: F.floor(F.log(F.col(c)) / np.log1p(2 * tolerance)).cast("bigint")
    signature = [F.lower(F.trim("make")).alias("make"), F.lower(F.trim("model")).alias("model"), F.round("focal", 2).alias("focal"), step("width").alias("w"), step("height").alias("h")]
    keyed = images.select("image_id", *signature)
    named = keyed.groupBy("make", "model", "focal", "w", "h").agg(F.min("image_id").alias("sensor"))
    same = reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(named[c]) for c in ("make", "model", "focal", "w", "h")])
    return keyed.join(named, same).select(keyed["image_id"], "sensor")


def rigs(images: DataFrame) -> DataFrame:
    """(capture, reference, image_id, band): band images of one capture and the one of the lowest band.

    images: image_id, capture, band.
    """
    first = images.groupBy("capture").agg(F.min(F.struct("band", "image_id"))["image_id"].alias("reference"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return images.join(first.drop("n"), "capture").select("capture", "reference", "image_id", "band")


def rig_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b): pairs of reference images, and each band with its own reference."""
    own = members.where("image_id <> reference").select(F.least("image_id", "reference").alias("id_a"), F.greatest("image_id", "reference").alias("id_b"))
    refs = members.select(F.col("reference").alias("id")).distinct()
    between = pairs.join(refs.withColumnRenamed("id", "id_a"), "id_a", "left_semi").join(refs.withColumnRenamed("id", "id_b"), "id_b", "left_semi").select("id_a", "id_b")
    return between.unionByName(own).distinct()


def unregistered_reason(keypoints: Column, degree: Column, rank: Column) -> Column:
    """The first reason that can be told for a photograph without a pose."""
    return F.when(keypoints.isNull() | (keypoints == 0), "no keypoints").when(degree == 0, "no matches").when(rank > 1, "apart from the main block").when(degree == 1, "one match only").otherwise("not placed")


def fuse_depths(pixels: DataFrame, cell: float, min_views: int = 2, tolerance: float = 0.02) -> DataFrame:
    """(ix, iy, iz, x, y, z, views): points of depth maps that enough maps agree on, merged by cell.

    pixels: map_id, x, y, z, depth (world points of valid pixels). Maps agree in a cell; a point far
    from the cell's median depth of its map is left out.
    """
    from terrafold.operators.cloud import with_cells

    celled = with_cells(pixels.where("depth > 0"), cell)
    middle = celled.groupBy("map_id", "ix", "iy", "iz").agg(F.percentile("depth", 0.5).alias("m"))
    near = celled.join(middle, ["map_id", "ix", "iy", "iz"]).where(F.abs(F.col("depth") - F.col("m")) <= tolerance * F.col("m"))
    # Views are counted over a map's one row in a cell, so no distinct count of all pixels.
    per_map = near.groupBy("ix", "iy", "iz", "map_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in "xyz"])
    merged = per_map.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("views"), F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in "xyz"])
    return merged.where(F.col("views") >= min_views).select("ix", "iy", "iz", *[(F.col(c) / F.col("n")).alias(c) for c in "xyz"], "views")


def depth_stats(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(valid share, min, max, median and p95 cost) of depth maps (depth, cost; depth <= 0: none)."""
    ok = F.col("depth") > 0
    return pixels.groupBy(*by).agg((F.count_if(ok) / F.count(F.lit(1))).alias("valid"), F.min(F.when(ok, F.col("depth"))).alias("nearest"), F.max(F.when(ok, F.col("depth"))).alias("farthest"), F.percentile(F.when(ok, F.col("cost")), 0.5).alias("cost"), F.percentile(F.when(ok, F.col("cost")), 0.95).alias("cost_p95"))


def speckle_filter(pixels: DataFrame, tolerance: float = 0.1, least: int = 3) -> DataFrame:
    """Pixels with enough of their eight neighbours within the relative tolerance (map_id, u, v, depth)."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    valid = pixels.where("depth > 0")
    moved = valid.select("map_id", "u", "v", "depth", offsets.alias("o")).select("map_id", (F.col("u") + F.col("o.i")).alias("u"), (F.col("v") + F.col("o.j")).alias("v"), F.col("depth").alias("near"))
    agree = moved.join(valid, ["map_id", "u", "v"]).where(F.abs(F.col("near") - F.col("depth")) <= tolerance * F.col("depth")).groupBy("map_id", "u", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return valid.join(agree, ["map_id", "u", "v"], "left_semi")


def majority(cells: DataFrame) -> DataFrame:
    """(row, col, label): the most frequent label of the 3 x 3 cells around, ties to the smaller."""
    from terrafold.operators.raster import shifted

    near = shifted(cells, [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)], "label").join(cells.select("row", "col"), ["row", "col"], "left_semi")
    counts = near.groupBy("row", "col", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("row", "col").agg(F.min(F.struct((-F.col("n")).alias("n"), "v"))["v"].alias("label"))


def label_areas(cells: DataFrame, gsd: float) -> DataFrame:
    return cells.groupBy("label").agg((F.count(F.lit(1)) * gsd * gsd).alias("area"))


def enclosed(cells: DataFrame) -> DataFrame:
    """(row, col) of gaps of the box that aren't joined to its border through gaps (four neighbours)."""
    from terrafold.operators import graph
    from terrafold.operators.raster import all_cells

    box = graph.settled(all_cells(cells))
    gaps = graph.settled(box.join(cells.select("row", "col"), ["row", "col"], "left_anti"))
    limits = box.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))  # one row
    named = gaps.join(F.broadcast(limits)).withColumn("id", F.shiftleft(F.col("row") - F.col("r0"), 31) + F.col("col") - F.col("c0"))
    right = named.select("id", (F.col("id") + 1).alias("to")).unionByName(named.select("id", (F.col("id") + (1 << 31)).alias("to")))
    edges = right.join(named.select(F.col("id").alias("to")), "to").select(F.col("id").alias("id_a"), F.col("to").alias("id_b"))
    labels = graph.components(named.select("id"), edges)
    part = named.join(labels, "id")
    outside = part.where("row = r0 OR row = r1 OR col = c0 OR col = c1").select("component").distinct()
    return part.join(outside, "component", "left_anti").select("row", "col")


def extract_levels(nodes: DataFrame, budget: int, min_spacing: float = 0.0) -> DataFrame:
    """Nodes of the coarse levels whose counts add up to the budget at most (nodes: level, count, spacing)."""
    per = nodes.groupBy("level").agg(F.sum("count").alias("n"), F.min("spacing").alias("s"))
    run = per.withColumn("run", F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)))  # a row a level
    return nodes.join(F.broadcast(run.where((F.col("run") <= budget) & (F.col("s") >= min_spacing)).select("level")), "level", "left_semi")


def rank_scenes(scenes: DataFrame) -> DataFrame:
    """Scenes that cover the area first, then by coverage, cloud, missing data, newest date."""
    return scenes.orderBy(F.desc(F.col("coverage") >= 0.99), F.desc("coverage"), "cloud", "nodata", F.desc("date"))


def tile_pyramid(tiles: DataFrame, levels: int) -> DataFrame:
    """(z, x, y, value): each level means the children that have data (tiles: z, x, y, value)."""
    out, now = [tiles], tiles
    for _ in range(levels):
        now = now.groupBy((F.col("z") - 1).alias("z"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.avg("value").alias("value"))
        out.append(now)
    return reduce(DataFrame.unionByName, out)


def affine_fit(marks: DataFrame, by: list[str]) -> DataFrame:
    """(a..f, n, rms) of px = a X + b Y + c, py = d X + e Y + f by least squares over each group's marks."""
    cov = lambda p, q: F.covar_pop(p, q)
    s = marks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in ("X", "Y", "px", "py")], cov("X", "X").alias("xx"), cov("Y", "Y").alias("yy"), cov("X", "Y").alias("xy"), cov("X", "px").alias("xu"), cov("Y", "px").alias("yu"), cov("X", "py").alias("xv"), cov("Y", "py").alias("yv"), cov("px", "px").alias("uu"), cov("py", "py").alias("vv"))
    det = F.nullif(F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"), F.lit(0.0))
    solve = lambda p, q: ((F.col(p) * F.col("yy") - F.col(q) * F.col("xy")) / det, (F.col(q) * F.col("xx") - F.col(p) * F.col("xy")) / det)
    (a, b), (d, e) = solve("xu", "yu"), solve("xv", "yv")
    rest = F.col("uu") - a * F.col("xu") - b * F.col("yu") + F.col("vv") - d * F.col("xv") - e * F.col("yv")
    return s.select(*by, "n", a.alias("a"), b.alias("b"), (F.col("mpx") - a * F.col("mX") - b * F.col("mY")).alias("c"), d.alias("d"), e.alias("e"), (F.col("mpy") - d * F.col("mX") - e * F.col("mY")).alias("f"), F.sqrt(F.greatest(F.lit(0.0), rest)).alias("rms"))


def names_and_stems(files: DataFrame) -> DataFrame:
    return files.select("file", basename(F.col("file")).alias("name"), stem(F.col("file")).alias("stem"))
