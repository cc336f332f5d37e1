"""Mesh operators on vertices (vid, x, y, z) and triangles (tid, v0, v1, v2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators import graph


def corners(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners (x0 .. z2)."""
    out = triangles.select("tid", "v0", "v1", "v2")
    for k in range(3):
        out = out.join(vertices.select(F.col("vid").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), f"v{k}")
    return out


def _cross() -> tuple[Column, Column, Column]:
    d = lambda c, k: F.col(f"{c}{k}") - F.col(f"{c}0")
    return (d("y", 1) * d("z", 2) - d("z", 1) * d("y", 2), d("z", 1) * d("x", 2) - d("x", 1) * d("z", 2), d("x", 1) * d("y", 2) - d("y", 1) * d("x", 2))


def area() -> Column:
    return F.sqrt(sum((c * c for c in _cross()), F.lit(0.0))) / 2


def measure(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """One row: triangles, area, signed volume (divergence theorem)."""
    n = _cross()
    volume = (F.col("x0") * n[0] + F.col("y0") * n[1] + F.col("z0") * n[2]) / 6
    return corners(vertices, triangles).agg(F.count(F.lit(1)).alias("triangles"), F.sum(area()).alias("area"), F.sum(volume).alias("volume"))


def edges(triangles: DataFrame) -> DataFrame:
    """(a, b, tid): the three edges of each triangle, the smaller vertex first."""
    sides = F.array(*[F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i, j in ((0, 1), (1, 2), (2, 0))])
    return triangles.select("tid", F.explode(sides).alias("e")).select("e.a", "e.b", "tid")


def topology(triangles: DataFrame) -> DataFrame:
    """One row: edges, boundary edges, non-manifold edges, and whether the mesh is watertight."""
    per = edges(triangles).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("n") == 1).alias("boundary"), F.count_if(F.col("n") > 2).alias("non_manifold"))
    return out.withColumn("watertight", (F.col("edges") > 0) & (F.col("boundary") == 0) & (F.col("non_manifold") == 0))


def face_adjacency(triangles: DataFrame) -> DataFrame:
    """(tid_a, tid_b) of triangles that share an edge of two."""
    per = edges(triangles).groupBy("a", "b").agg(F.sort_array(F.collect_set("tid")).alias("t")).where(F.size("t") == 2)
    return per.select(F.col("t")[0].alias("tid_a"), F.col("t")[1].alias("tid_b")).distinct()


def triangle_components(triangles: DataFrame) -> DataFrame:
    """(tid, component): triangles joined by shared vertices; the smallest vertex names one."""
    e = edges(triangles).where("a <> b").select(F.col("a").alias("id_a"), F.col("b").alias("id_b")).distinct()
    labels = graph.components(triangles.select(F.col("v0").alias("id")), e)
    return triangles.select("tid", F.col("v0").alias("id")).join(labels, "id").select("tid", "component")


def drop_small(triangles: DataFrame, least: int) -> DataFrame:
    """Without components of fewer than `least` triangles."""
    part = triangle_components(triangles)
    kept = part.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return triangles.join(part.join(kept, "component", "left_semi").select("tid"), "tid", "left_semi")


def edge_lengths(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    side = lambda v: vertices.select(F.col("vid").alias(v), *[F.col(c).alias(f"{c}_{v}") for c in "xyz"])
    out = edges(triangles).join(side("a"), "a").join(side("b"), "b")
    return out.select("a", "b", "tid", F.sqrt(sum(((F.col(f"{c}_a") - F.col(f"{c}_b")) ** 2 for c in "xyz"), F.lit(0.0))).alias("length"))


def drop_long_edges(vertices: DataFrame, triangles: DataFrame, factor: float = 6.0) -> DataFrame:
    """Without triangles that have an edge over factor times the median one."""
    length = edge_lengths(vertices, triangles)
    limit = length.select("a", "b", "length").distinct().agg((F.percentile("length", 0.5) * factor).alias("limit"))  # one row
    return triangles.join(length.join(F.broadcast(limit)).where("length > limit").select("tid"), "tid", "left_anti")


def weld(vertices: DataFrame, triangles: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """Vertices of one cell become the one of the smallest number; collapsed triangles go."""
    cell = [F.floor(F.col(c) / size + 0.5).cast("bigint").alias(f"i{c}") for c in "xyz"]
    own = vertices.select("vid", *cell)
    first = own.groupBy("ix", "iy", "iz").agg(F.min("vid").alias("to"))
    moved = own.join(first, ["ix", "iy", "iz"]).select("vid", "to")
    out = triangles
    for k in range(3):
        out = out.join(moved.select(F.col("vid").alias(f"v{k}"), F.col("to").alias(f"t{k}")), f"v{k}").drop(f"v{k}").withColumnRenamed(f"t{k}", f"v{k}")
    out = out.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0").select(*triangles.columns)
    return vertices.join(moved.select(F.col("to").alias("vid")).distinct(), "vid", "left_semi"), out


def compact(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """Vertices that some triangle uses."""
    used = triangles.select(F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, "vid", "left_semi")


def crop(vertices: DataFrame, triangles: DataFrame, low: dict, high: dict, invert: bool = False) -> DataFrame:
    """Triangles whose corners are all inside the box (or, inverted, not all)."""
    from terrafold.operators.cloud import crop_box

    inside = crop_box(vertices, low, high).select("vid")
    out = triangles.select("tid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(inside, "vid", "left_semi").groupBy("tid").agg(F.count(F.lit(1)).alias("n")).where("n = 3").select("tid")
    return triangles.join(out, "tid", "left_anti" if invert else "left_semi")


def sample(vertices: DataFrame, triangles: DataFrame, per_area: float, seed: int = 1) -> DataFrame:
    """(tid, x, y, z): points spread evenly, about per_area of them for a unit of area.

    A triangle draws the whole part of its share, and one more with the chance of the rest; all
    draws come from hashes of the triangle, so reruns agree. Triangles without area draw none.
    """
    unit = lambda *k: F.shiftrightunsigned(F.xxhash64("tid", *map(F.lit, k), F.lit(seed)), 11).cast("double") / float(2**53)
    share = area() * per_area
    drawn = corners(vertices, triangles).withColumn("m", (F.floor(share) + (unit(0) < share - F.floor(share)).cast("int")).cast("int")).where("m > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m"))))
    root = F.sqrt(F.shiftrightunsigned(F.xxhash64("tid", "k", F.lit(seed), F.lit(1)), 11).cast("double") / float(2**53))
    other = F.shiftrightunsigned(F.xxhash64("tid", "k", F.lit(seed), F.lit(2)), 11).cast("double") / float(2**53)
    a, b, c = 1 - root, root * (1 - other), root * other
    return drawn.select("tid", *[(a * F.col(f"{d}0") + b * F.col(f"{d}1") + c * F.col(f"{d}2")).alias(d) for d in "xyz"])


def smooth(vertices: DataFrame, triangles: DataFrame, rounds: int = 10, lam: float = 0.5, mu: float = -0.53) -> DataFrame:
    """Taubin's smoothing: means of neighbours, inwards and outwards in turn; boundary vertices stay."""
    around = graph.settled(edges(triangles).where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    fixed = around.where("n = 1").select(F.explode(F.array("a", "b")).alias("vid")).distinct()
    both = graph.settled(around.select("a", "b").unionByName(around.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    free = graph.settled(vertices.select("vid").join(fixed, "vid", "left_anti"))
    now = vertices
    for k in range(2 * rounds):
        step = lam if k % 2 == 0 else mu
        mean = both.join(now.select(F.col("vid").alias("b"), "x", "y", "z"), "b").groupBy(F.col("a").alias("vid")).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"]).join(free, "vid", "left_semi")
        now = graph.settled(now.join(mean, "vid", "left").select("vid", *[(F.col(c) + step * F.coalesce(F.col(f"m{c}") - F.col(c), F.lit(0.0))).alias(c) for c in "xyz"]))
    return now


def to_obj(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(part, number, value): OBJ lines; vertex numbers must run from 1 (see numbered)."""
    v = vertices.select(F.lit(0).alias("part"), F.col("vid").alias("number"), F.concat_ws(" ", F.lit("v"), "x", "y", "z").alias("value"))
    f = triangles.select(F.lit(1).alias("part"), F.col("tid").alias("number"), F.concat_ws(" ", F.lit("f"), "v0", "v1", "v2").alias("value"))
    return v.unionByName(f).orderBy("part", "number")


def numbered(vertices: DataFrame, triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices renumbered from 1 without gaps: ranges are numbered apart and their counts added up."""
    ranged = graph.settled(vertices.repartitionByRange("vid").sortWithinPartitions("vid").withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    start = F.coalesce(*[F.when(F.col("_p") == p, F.lit(b)) for p, b in before.items()], F.lit(0)) if before else F.lit(0)
    named = ranged.withColumn("to", start + F.row_number().over(Window.partitionBy("_p").orderBy("vid")))
    key = graph.settled(named.select("vid", "to"))
    out = triangles
    for k in range(3):
        out = out.join(key.select(F.col("vid").alias(f"v{k}"), F.col("to").alias(f"t{k}")), f"v{k}").drop(f"v{k}").withColumnRenamed(f"t{k}", f"v{k}")
    return named.drop("_p").withColumn("vid", F.col("to")).drop("to"), out.select(*triangles.columns)
