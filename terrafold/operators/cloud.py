"""Point-cloud operators: points are rows with x, y, z and whatever else they carry.

Cells are anchored at the origin: floor(x / cell). Everything is a grouping or a join by cell,
so work spreads over cells whatever the cloud's size; what is asked of neighbourhoods is worked out by place (near.py).
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.functions.stats import rounded
from terrafold.operators import near


def cell(c: str | Column, size: float) -> Column:
    return F.floor((F.col(c) if isinstance(c, str) else c) / size).cast("bigint")


def with_cells(points: DataFrame, size: float, dims: str = "xyz") -> DataFrame:
    return points.withColumns({f"i{d}": cell(d, size) for d in dims})


def crop_box(points: DataFrame, low: dict[str, float | None], high: dict[str, float | None], invert: bool = False) -> DataFrame:
    """Points inside the box, its faces included; a missing bound is open."""
    inside = reduce(lambda a, b: a & b, [F.col(d) >= v for d, v in low.items() if v is not None] + [F.col(d) <= v for d, v in high.items() if v is not None], F.lit(True))
    return points.where(~inside if invert else inside)


def mask_cloud(points: DataFrame, selected: DataFrame, keep: bool = True) -> DataFrame:
    """The selected points (by pid), or with keep=False the others. Repeated ids select once."""
    return points.join(selected.select("pid").distinct(), "pid", "left_semi" if keep else "left_anti")


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    """Rec. 709 luma."""
    return F.col(r) * 0.2126 + F.col(g) * 0.7152 + F.col(b) * 0.0722


def filter_range(points: DataFrame, z_min: float | None = None, z_max: float | None = None, luma_min: float | None = None, luma_max: float | None = None) -> DataFrame:
    """A band of heights and one of luma; luma bounds are ignored without colour."""
    tests = [F.col("z") >= z_min if z_min is not None else None, F.col("z") <= z_max if z_max is not None else None]
    if {"r", "g", "b"} <= set(points.columns):
        tests += [luma() >= luma_min if luma_min is not None else None, luma() <= luma_max if luma_max is not None else None]
    return points.where(reduce(lambda a, b: a & b, [t for t in tests if t is not None], F.lit(True)))


def voxel_mean(points: DataFrame, size: float) -> DataFrame:
    """A point a cell: mean position, rounded mean colour, renormalised mean normal.

    A non-positive size returns the points. Normals of no length become (0, 0, 1).
    """
    if size <= 0:
        return points
    has = set(points.columns)
    aggs = [F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in "xyz"), *(rounded(F.avg(c)).cast("bigint").alias(c) for c in "rgb" if c in has)]
    normals = {"nx", "ny", "nz"} <= has
    if normals:
        aggs += [F.sum(c).alias(f"_{c}") for c in ("nx", "ny", "nz")]
    out = with_cells(points, size).groupBy("ix", "iy", "iz").agg(*aggs)
    if normals:
        length = F.sqrt(sum((F.col(f"_{c}") ** 2 for c in ("nx", "ny", "nz")), F.lit(0.0)))
        out = out.withColumns({c: F.when(length > 1e-9, F.col(f"_{c}") / length).otherwise(1.0 if c == "nz" else 0.0) for c in ("nx", "ny", "nz")}).drop("_nx", "_ny", "_nz")
    return out


def voxel_first(points: DataFrame, size: float, order: str = "pid") -> DataFrame:
    """The first point of each cell with all it carries (the rule for scalar attributes)."""
    first = Window.partitionBy("ix", "iy", "iz").orderBy(order)
    return with_cells(points, size).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def merge_clouds(clouds: list[DataFrame], size: float) -> DataFrame:
    """The union by name; in a cell that several inputs share only the first one's points stay.

    Columns that some cloud lacks are dropped; without colour a point is grey (200).
    """
    colour = any({"r", "g", "b"} <= set(c.columns) for c in clouds)
    if colour:
        clouds = [c if {"r", "g", "b"} <= set(c.columns) else c.withColumns({k: F.lit(200) for k in "rgb"}) for c in clouds]
    shared = [c for c in clouds[0].columns if all(c in o.columns for o in clouds)]
    every = reduce(DataFrame.unionByName, [c.select(*shared, F.lit(k).alias("src")) for k, c in enumerate(clouds)])
    if size <= 0:
        return every
    # The owner of each cell is a small aggregate: no window over all points of a cell.
    owned = with_cells(every, size)
    owner = owned.groupBy("ix", "iy", "iz").agg(F.min("src").alias("owner"))
    return owned.join(owner, ["ix", "iy", "iz"]).where("src = owner").drop("owner")


def neighbours(dims: int = 3, self_too: bool = False) -> Column:
    """All offsets of -1..1 in so many dimensions, as an array of structs dx, dy(, dz)."""
    names = ["dx", "dy", "dz"][:dims]
    offsets = [()]
    for _ in names:
        offsets = [(*o, d) for o in offsets for d in (-1, 0, 1)]
    return F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(names, o, strict=True)]) for o in offsets if self_too or any(o)])


def remove_isolated(points: DataFrame, size: float, min_neighbours: int = 2, max_support: int = 2) -> DataFrame:
    """Drops points of cells with at most max_support points and few occupied neighbour cells."""
    celled = with_cells(points, size)
    cells = celled.groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("n"))
    sparse = cells.where(F.col("n") <= max_support)
    around = sparse.select("ix", "iy", "iz", F.explode(neighbours()).alias("o")).select("ix", "iy", "iz", (F.col("ix") + F.col("o.dx")).alias("jx"), (F.col("iy") + F.col("o.dy")).alias("jy"), (F.col("iz") + F.col("o.dz")).alias("jz"))
    occupied = cells.select(F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("iz").alias("jz"))
    held = around.join(occupied, ["jx", "jy", "jz"]).groupBy("ix", "iy", "iz").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_neighbours)
    kept = cells.where(F.col("n") > max_support).select("ix", "iy", "iz").unionByName(held.select("ix", "iy", "iz"))
    return celled.join(kept, ["ix", "iy", "iz"], "left_semi")


def near_pairs(source: DataFrame, target: DataFrame, reach: float, strict: bool = True) -> DataFrame:
    """(pid, qid, d2) of all source and target points nearer than reach, by a join of cells.

    source: pid, x, y, z; target: qid, tx, ty, tz. The cell is the reach, so a point's
    partners lie in its own and the 26 cells around it.
    """
    a = with_cells(source.select("pid", "x", "y", "z"), reach).withColumn("o", F.explode(neighbours(self_too=True)))
    a = a.select("pid", "x", "y", "z", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("iz") + F.col("o.dz")).alias("iz"))
    b = target.select("qid", "tx", "ty", "tz", cell("tx", reach).alias("ix"), cell("ty", reach).alias("iy"), cell("tz", reach).alias("iz"))
    d2 = (F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2 + (F.col("z") - F.col("tz")) ** 2
    limit = reach * reach
    out = a.join(b, ["ix", "iy", "iz"]).withColumn("d2", d2)
    return out.where(F.col("d2") < limit if strict else F.col("d2") <= limit).select("pid", "qid", "d2")


def near_others(points: DataFrame, reach: float) -> DataFrame:
    """(pid, qid, d2) of all pairs of different points of one cloud nearer than reach, both ways round.

    A pair is met once, by the half of the cells around that come later in order (14 of 27 with
    its own), and then told both ways: half the copies of a join with all of them.
    """
    later = [o for o in itertools.product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in zip(("dx", "dy", "dz"), o, strict=True)]) for o in later])
    celled = with_cells(points.select("pid", "x", "y", "z"), reach)
    a = celled.withColumn("o", F.explode(offsets)).select(F.col("pid").alias("pa"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"), (F.col("o") == F.struct(*[F.lit(0).cast("bigint").alias(n) for n in ("dx", "dy", "dz")])).alias("own"), *[(F.col(f"i{d}") + F.col(f"o.d{d}")).alias(f"i{d}") for d in "xyz"])
    b = celled.select(F.col("pid").alias("pb"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.col("z").alias("zb"), "ix", "iy", "iz")
    d2 = sum((F.pow(F.col(f"{d}a") - F.col(f"{d}b"), F.lit(2)) for d in "yz"), F.pow(F.col("xa") - F.col("xb"), F.lit(2)))
    met = a.join(b, ["ix", "iy", "iz"]).where(~F.col("own") | (F.col("pa") < F.col("pb"))).select("pa", "pb", d2.alias("d2")).where(F.col("d2") < reach * reach)
    ways = F.array(F.struct(F.col("pa").alias("pid"), F.col("pb").alias("qid")), F.struct(F.col("pb").alias("pid"), F.col("pa").alias("qid")))
    return met.select(F.explode(ways).alias("w"), "d2").select("w.pid", "w.qid", "d2")


def as_target(points: DataFrame) -> DataFrame:
    return points.select(F.col("pid").alias("qid"), F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"))


def neighbour_counts(points: DataFrame, reach: float) -> DataFrame:
    """(pid, n, nearest): the number of other points nearer than reach, and the least squared distance; lonely points are absent."""
    found = near.around(points, reach).where("n > 1").select("x", "y", "z", F.col("n") - 1, "nearest")
    return near.at_places(points.select("pid", "x", "y", "z"), found.toDF("x", "y", "z", "n", "nearest")).select("pid", "n", "nearest")


def neighbour_means(points: DataFrame, reach: float, k: int = 12) -> DataFrame:
    """(pid, mean): mean distance to the k nearest others within reach; lonely points are absent."""
    return near.at_places(points.select("pid", "x", "y", "z"), near.nearest_means(points, reach, k)).select("pid", "mean")


def outlier_filter(points: DataFrame, reach: float, k: int = 12, std_ratio: float = 1.5) -> DataFrame:
    """Statistical outlier filter: drops lonely points and those with a mean above mu + ratio sigma.

    Fewer than three points come back as they are.
    """
    from terrafold.operators.graph import settled

    if points.limit(3).count() < 3:
        return points
    means = settled(near.nearest_means(points, reach, k))  # places, read again
    mu = F.sum(F.col("w") * F.col("mean")) / F.sum("w")
    centre = means.agg(mu.alias("mu"))
    sigma = F.sqrt(F.sum(F.col("w") * F.pow(F.col("mean") - F.col("mu"), F.lit(2))) / F.sum("w"))
    limit = means.join(F.broadcast(centre)).groupBy("mu").agg((F.col("mu") + std_ratio * sigma).alias("limit"))  # one row
    kept = means.join(F.broadcast(limit.select("limit"))).where("mean <= limit").select("x", "y", "z")
    return near.at_places(points, kept, how="left_semi")


def filter_chain(points: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """Range, voxel, isolated and outlier filters in the given order, each on the last one's output."""
    known = {"range": filter_range, "voxel": voxel_first, "isolated": remove_isolated, "outlier": outlier_filter}
    for name, options in steps:
        points = known[name](points, **options)
        points = points.drop("ix", "iy", "iz")
    return points


def cloud_distance(source: DataFrame, reference: DataFrame, reach: float) -> DataFrame:
    """(pid, distance, qid) of every source point to its nearest reference; null beyond reach.

    Equal distances go to the smaller reference id.
    """
    found = near.nearest_of(source, reference, reach)
    return near.at_places(source.select("pid", "x", "y", "z"), found, how="left").select("pid", F.sqrt("d2").alias("distance"), "qid")


def section(points: DataFrame, a: tuple[float, float], b: tuple[float, float], thickness: float, extend: bool = False) -> DataFrame:
    """Points near the vertical plane through a and b, with station and offset (left positive)."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = (dx * dx + dy * dy) ** 0.5
    ux, uy = dx / length, dy / length
    px, py = F.col("x") - a[0], F.col("y") - a[1]
    out = points.withColumn("station", px * ux + py * uy).withColumn("offset", py * ux - px * uy).where(F.abs("offset") <= thickness / 2)
    return out if extend else out.where((F.col("station") >= 0) & (F.col("station") <= length))


def bounds(points: DataFrame) -> DataFrame:
    """One row: the box and the count."""
    return points.agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{name}") for c in "xyz" for name, f in (("min", F.min), ("max", F.max))))


def spacing(points: DataFrame) -> DataFrame:
    """One row: spacing by volume (over extents that aren't zero) and by area."""
    b = bounds(points)
    sizes = {c: F.col(f"{c}_max") - F.col(f"{c}_min") for c in "xyz"}
    dims = sum((F.when(v > 0, 1).otherwise(0) for v in sizes.values()), F.lit(0))
    volume = reduce(lambda p, q: p * q, [F.when(v > 0, v).otherwise(1.0) for v in sizes.values()])
    return b.select("n", F.when(dims > 0, F.pow(volume / F.col("n"), 1.0 / F.nullif(dims, F.lit(0)))).alias("by_volume"), F.sqrt(sizes["x"] * sizes["y"] / F.col("n")).alias("by_area"))


def octree_pick(points: DataFrame, corner: tuple[float, float, float], edge: float, grid: int = 128) -> DataFrame:
    """The point nearest to the centre of each cell of a grid over a cube; ties to the smaller pid."""
    step = edge / grid
    at = {d: F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor((F.col(d) - c) / step))).cast("bigint") for d, c in zip("xyz", corner, strict=True)}
    off = sum((F.pow((F.col(d) - c) / step - at[d] - 0.5, F.lit(2)) for d, c in zip("xyz", corner, strict=True)), F.lit(0.0))
    placed = points.select(*[at[d].alias(f"i{d}") for d in "xyz"], "pid", off.alias("d2"))
    return placed.groupBy("ix", "iy", "iz").agg(F.min(F.struct("d2", "pid")).alias("m")).select("ix", "iy", "iz", F.col("m.pid").alias("pid"))


def octree_levels(points: DataFrame, corner: tuple[float, float, float], edge: float, grid: int, leaf: int, most: int = 12) -> DataFrame:
    """Level of detail: each point goes to exactly one node (level, nx, ny, nz).

    A node keeps one point for each cell of its grid and passes the rest to its children, until
    at most `leaf` points are left in it. A level is one grouping over what is left.
    """
    from terrafold.operators.graph import settled

    rest, out = points, []
    for level in range(most + 1):
        size = edge / 2**level
        step = size / grid
        node = {f"n{d}": F.least(F.lit(2**level - 1), F.greatest(F.lit(0), F.floor((F.col(d) - c) / size))).cast("bigint") for d, c in zip("xyz", corner, strict=True)}
        placed = settled(rest.withColumns(node))
        full = placed.groupBy("nx", "ny", "nz").agg(F.count(F.lit(1)).alias("held")).withColumn("whole", F.col("held") <= leaf)
        known = placed.join(full.drop("held"), ["nx", "ny", "nz"])
        local = {d: F.col(d) - c - F.col(f"n{d}") * size for d, c in zip("xyz", corner, strict=True)}
        at = {f"c{d}": F.least(F.lit(grid - 1), F.greatest(F.lit(0), F.floor(local[d] / step))).cast("bigint") for d in "xyz"}
        off = sum((F.pow(local[d] / step - at[f"c{d}"] - 0.5, F.lit(2)) for d in "xyz"), F.lit(0.0))
        celled = known.where("not whole").withColumns(at).withColumn("d2", off)
        picked = celled.groupBy("nx", "ny", "nz", "cx", "cy", "cz").agg(F.min(F.struct("d2", "pid")).alias("m")).select(F.col("m.pid").alias("pid"))
        stays = known.where("whole").select("pid") if level < most else known.select("pid")
        here = settled(stays.unionByName(picked).distinct() if level < most else stays)
        out.append(placed.join(here, "pid", "left_semi").select("pid", F.lit(level).alias("level"), "nx", "ny", "nz"))
        rest = settled(placed.join(here, "pid", "left_anti").drop("nx", "ny", "nz"))
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def transform(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """A 4 x 4 affine map; the map of the normals is its inverse transpose."""
    row = lambda r, c: sum((F.col(k) * r[i] for i, k in enumerate(c)), F.lit(0.0))
    out = {d: row(matrix[i], "xyz") + matrix[i][3] for i, d in enumerate("xyz")}
    if {"nx", "ny", "nz"} <= set(points.columns):
        m = matrix
        cof = [[m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
        turned = [row(cof[i], ("nx", "ny", "nz")) for i in range(3)]
        length = F.sqrt(sum((t * t for t in turned), F.lit(0.0)))
        out |= {n: F.when(length > 0, t / length).otherwise(F.col(n)) for n, t in zip(("nx", "ny", "nz"), turned, strict=True)}
    return points.withColumns(out)


def class_counts(points: DataFrame, column: str = "classification") -> DataFrame:
    return points.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def covariance_normals(points: DataFrame, reach: float, shift: float = 0.0, digits: int | None = None) -> DataFrame:
    """(pid, n, cxx, cxy, cxz, cyy, cyz, czz): covariance of the points within reach, own included.

    shift is added to each; with digits they are rounded to so many, once a place.
    """
    names = ["cxx", "cxy", "cxz", "cyy", "cyz", "czz"]

    def tell(n, c):
        return [n.astype("int64"), *[near.decimals(x + shift, digits) for x in c]]

    found = near.spread(points, reach, tell, "n bigint, " + ", ".join(f"{c} double" for c in names))
    return near.at_places(points.select("pid", "x", "y", "z"), found).select("pid", "n", *names)
