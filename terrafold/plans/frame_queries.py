"""Queries of photographs, surfaces and imported features on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import frames, surface
from terrafold.plans import views as V
from terrafold.plans.cloud_queries import r6
from terrafold.plans.register import Catalog
from terrafold.sources import imports, lod

catalog = Catalog()
query = catalog.query

# Photographs look straight down: x to the right, y up the picture. A supplier is a photograph.
_SHOTS = "shots AS (SELECT s_suppkey AS id, (s_suppkey * 37 % 101)::DOUBLE AS px, (s_suppkey * 53 % 101)::DOUBLE AS py, 80.0 + s_suppkey % 5 * 4 AS h FROM supplier)"


def _photos(spark, d, focal: float, width: int, height: int):
    k = F.col("s_suppkey")
    px, py, h = (k * 37 % 101).cast("double"), (k * 53 % 101).cast("double"), F.lit(80.0) + k % 5 * 4
    r = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    pose = [F.lit(v).alias(f"r{i}") for i, v in enumerate(r)] + [(-px).alias("t0"), py.alias("t1"), h.alias("t2")]
    lens = [F.lit(float(focal)).alias("fx"), F.lit(float(focal)).alias("fy"), F.lit(width / 2).alias("cx"), F.lit(height / 2).alias("cy"), F.lit(width).alias("width"), F.lit(height).alias("height")]
    side = h * width / focal  # more than any ground cell in the frame is away
    box = [(px - side).alias("x0"), (py - side).alias("y0"), (px + side).alias("x1"), (py + side).alias("y1")]
    return V.table(spark, d, "supplier").select(k.alias("image_id"), *pose, *lens, *box)


def _ground(spark, d):
    c = V.cells(spark, d)
    return c.select("row", "col", ((F.col("col") + 0.5) * 4.0).alias("x"), (104.0 - (F.col("row") + 0.5) * 4.0).alias("y"), "z")


_GROUND = f"{V.CELLS}, ground AS (SELECT row, col, (col + 0.5) * 4.0 AS x, 104.0 - (row + 0.5) * 4.0 AS y, z FROM cells), {_SHOTS}"
_VIEWS = "SELECT row, col, id, {f} * (x - px) / (h - z) + {cx} AS u, {f} * (py - y) / (h - z) + {cy} AS v, h - z AS depth FROM ground, shots WHERE h - z > 1e-12"


@query(f"WITH {_GROUND}, v AS ({_VIEWS.format(f=1000.0, cx=500.0, cy=400.0)}), k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY ((u-500)/1000)**2 + ((v-400)/1000)**2, id) rn FROM v WHERE u >= 2 AND v >= 2 AND u <= 997 AND v <= 797) SELECT row, col, id image_id, round(u, 6) u, round(v, 6) v FROM k WHERE rn = 1")
def nadir_captures(spark, d):
    out = surface.best_captures(_ground(spark, d), _photos(spark, d, 1000, 1000, 800))
    return out.withColumns(r6("u", "v"))


_PIXELS = "pixels AS (SELECT id, pu, pv, h - 25.0 + (pu * 7 + pv * 3 + id) % 7 - 3 AS stored, ((pu * 3 + pv * 5 + id * 7) % 10) / 12.0 AS cost, (pu * 11 + id) % 256 AS r, (pv * 13 + id) % 256 AS g, (pu + pv + id) % 256 AS b FROM shots, (SELECT unnest(range(20)) pu), (SELECT unnest(range(16)) pv))"
_MET = f"WITH {_GROUND}, v AS ({_VIEWS.format(f=20.0, cx=10.0, cy=8.0)}), {_PIXELS}, m AS (SELECT row, col, v.id, depth, cost, r, g, b FROM v JOIN pixels p ON p.id = v.id AND p.pu = floor(u + 0.5) AND p.pv = floor(v + 0.5) WHERE stored > 0 AND abs(stored - depth) <= 0.05 * depth AND cost <= 0.6)"


def _pixels(spark, d):
    k = F.col("s_suppkey")
    steps = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = V.table(spark, d, "supplier").select("s_suppkey").withColumn("pu", steps(20)).withColumn("pv", steps(16))
    pu, pv = F.col("pu"), F.col("pv")
    depth = 80.0 + k % 5 * 4 - 25.0 + (pu * 7 + pv * 3 + k) % 7 - 3
    cost = ((pu * 3 + pv * 5 + k * 7) % 10) / 12.0
    return p.select(k.alias("image_id"), pu.cast("bigint").alias("pu"), pv.cast("bigint").alias("pv"), depth.alias("depth"), cost.alias("cost"), ((pu * 11 + k) % 256).alias("r"), ((pv * 13 + k) % 256).alias("g"), ((pu + pv + k) % 256).alias("b"))


@query(_MET + ", k AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY cost + 1e-6 * depth, id) rn FROM m) SELECT row, col, r, g, b, id image_id FROM k WHERE rn = 1")
def ortho_best(spark, d):
    return surface.sample_ortho(_ground(spark, d), _photos(spark, d, 20, 20, 16), _pixels(spark, d), depth_tol=0.05)


@query(_MET + " SELECT row, col, CAST(floor(sum(r/(cost+1e-3))/sum(1/(cost+1e-3))+0.5) AS BIGINT) r, CAST(floor(sum(g/(cost+1e-3))/sum(1/(cost+1e-3))+0.5) AS BIGINT) g, CAST(floor(sum(b/(cost+1e-3))/sum(1/(cost+1e-3))+0.5) AS BIGINT) b FROM m GROUP BY 1, 2")
def ortho_average(spark, d):
    out = surface.sample_ortho(_ground(spark, d), _photos(spark, d, 20, 20, 16), _pixels(spark, d), depth_tol=0.05, blend="average")
    return out.drop("image_id")


_CORNERS = "corners AS (SELECT id, px + (u - 500.0) / 1000.0 * dd AS x, py - (v - 400.0) / 1000.0 * dd AS y, h - dd AS z FROM shots, (SELECT unnest([-0.5, 999.5]) u), (SELECT unnest([-0.5, 799.5]) v), (SELECT unnest([40.0, 70.0]) dd))"


@query(f"WITH {_SHOTS}, {_CORNERS}, j AS (SELECT c.id, s.id AS other, CASE WHEN s.h - c.z > 1e-12 THEN 1000 * (c.x - s.px) / (s.h - c.z) + 500 END AS u, CASE WHEN s.h - c.z > 1e-12 THEN 1000 * (s.py - c.y) / (s.h - c.z) + 400 END AS v FROM corners c JOIN shots s ON s.id <> c.id), k AS (SELECT id, other FROM j GROUP BY 1, 2 HAVING count(u) > 0 AND NOT (count(u) = 8 AND (max(u) < -2.5 OR min(u) > 1001.5 OR max(v) < -2.5 OR min(v) > 801.5))), a AS (SELECT k.id, other, sqrt((s.px-o.px)**2+(s.py-o.py)**2+(s.h-o.h)**2) AS away FROM k JOIN shots s ON s.id = k.id JOIN shots o ON o.id = other) SELECT id image_id, other, CAST(row_number() OVER (PARTITION BY id ORDER BY round(away, 9), other) AS INT) AS rank FROM a")
def view_candidates(spark, d):
    maps = _photos(spark, d, 1000, 1000, 800).withColumns({"near": F.lit(40.0), "far": F.lit(70.0)})
    return frames.filter_candidates(maps)


_SEEDS = V.EDGES + ", p AS (SELECT id_a, id_b, inliers FROM edges WHERE inliers >= 15 AND (id_a + id_b) % 5 <> 0 AND id_a * id_b % 17 <> 0), fresh AS (SELECT *, id_a % 4 = 0 AND id_b % 4 = 0 AS old FROM p)"


@query(f"WITH {_SEEDS}, f AS (SELECT * FROM fresh WHERE NOT old OR (SELECT bool_and(old) FROM fresh)), k AS (SELECT id_a, id_b, inliers, CAST(row_number() OVER (ORDER BY inliers DESC, id_a, id_b) AS INT) AS rank FROM f) SELECT * FROM k WHERE rank <= 240")
def seed_pairs(spark, d):
    a, b = F.col("id_a"), F.col("id_b")
    pairs = V.edges(spark, d).withColumns({"has_model": (a + b) % 5 != 0, "excluded": a * b % 17 == 0})
    explored = V.table(spark, d, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id"))
    return frames.rank_seeds(pairs, explored=explored)


_TRI = f"{V.CELLS}, t AS (SELECT a.col*4.0 x0, 104-a.row*4.0 y0, a.z z0, b.col*4.0 x1, 104-b.row*4.0 y1, b.z z1, c.col*4.0 x2, 104-c.row*4.0 y2, c.z z2 FROM cells a JOIN cells b ON b.row=a.row AND b.col=a.col+1 JOIN cells c ON c.row=a.row+1 AND c.col=a.col), s AS (SELECT *, (y1-y2)*(x0-x2)+(x2-x1)*(y0-y2) det, greatest(0, ceil((104-greatest(y0,y1,y2))/1.5-0.5))::BIGINT r0, least(69, floor((104-least(y0,y1,y2))/1.5-0.5))::BIGINT r1, greatest(0, ceil(least(x0,x1,x2)/1.5-0.5))::BIGINT c0, least(69, floor(greatest(x0,x1,x2)/1.5-0.5))::BIGINT c1 FROM t), p AS (SELECT *, unnest(range(r0, r1+1)) AS row FROM s), q AS (SELECT *, unnest(range(c0, c1+1)) AS col FROM p), w AS (SELECT *, (col+0.5)*1.5 px, 104-(row+0.5)*1.5 py FROM q), l AS (SELECT *, ((y1-y2)*(px-x2)+(x2-x1)*(py-y2))/det l0, ((y2-y0)*(px-x2)+(x0-x2)*(py-y2))/det l1 FROM w)"


@query(f"WITH {_TRI} SELECT row, col, round(max(l0*z0+l1*z1+(1-l0-l1)*z2), 6) z FROM l WHERE l0 >= -1e-9 AND l1 >= -1e-9 AND 1-l0-l1 >= -1e-9 GROUP BY 1, 2")
def mesh_heights(spark, d):
    c, at = V.cells(spark, d), lambda r, q: r * 1000 + q
    r, q = F.col("row"), F.col("col")
    vertices = c.select(at(r, q).alias("vid"), (q * 4.0).alias("x"), (104.0 - r * 4.0).alias("y"), "z")
    corner = lambda dr, dq: c.select((r - dr).alias("row"), (q - dq).alias("col"))
    t = c.select("row", "col").join(corner(0, 1), ["row", "col"]).join(corner(1, 0), ["row", "col"])
    triangles = t.select(at(r, q).alias("tid"), at(r, q).alias("v0"), at(r, q + 1).alias("v1"), at(r + 1, q).alias("v2"))
    return surface.mesh_surface(vertices, triangles, 1.5, 0.0, 104.0, 70, 70).withColumns(r6("z"))


_FIT = "(SELECT *, (xz*yy-yz*xy)/(xx*yy-xy*xy) a, (yz*xx-xz*xy)/(xx*yy-xy*xy) b FROM (SELECT avg(x) mx, avg(y) my, avg(z) mz, covar_pop(x,x) xx, covar_pop(x,y) xy, covar_pop(y,y) yy, covar_pop(x,z) xz, covar_pop(y,z) yz FROM {0}))"


@query(f"WITH {V.CELLS}, pts AS (SELECT (col+0.5)*4.0 x, 104-(row+0.5)*4.0 y, z + col*0.3 AS z FROM cells), f AS {_FIT.format('pts')}, o AS (SELECT pts.*, abs(z-(a*(x-mx)+b*(y-my)+mz)) away FROM pts, f), kept AS (SELECT x, y, z FROM o WHERE away <= 2.5*1.4826*(SELECT quantile_cont(away, 0.5) FROM o)), g AS {_FIT.format('kept')} SELECT id // 20 AS row, id % 20 AS col, round(a*((id%20+0.5)*5.2-mx)+b*(104-(id//20+0.5)*5.2-my)+mz, 5) z FROM range(400) t(id), g")
def plane_heights(spark, d):
    ground = _ground(spark, d).withColumn("z", F.col("z") + F.col("col") * 0.3)
    return surface.plane_surface(ground, 5.2, 0.0, 104.0, 20, 20).withColumn("z", F.round("z", 5))


_COLOURED = f"{V.HOLED}, own AS (SELECT row, col, CAST(floor(z*5) AS BIGINT) % 256 r, (row*7) % 256 g, (col*9) % 256 b FROM holed), gap AS (SELECT row, col FROM cells ANTI JOIN own USING (row, col)), near AS (SELECT h.row, h.col, o.r, o.g, o.b, (h.row-o.row)**2+(h.col-o.col)**2 AS d2 FROM gap h JOIN own o ON (h.row-o.row)**2+(h.col-o.col)**2 <= 4)"


@query(f"WITH {_COLOURED} SELECT row, col, r, g, b, 0 AS filled FROM own UNION ALL SELECT row, col, CAST(floor(sum(r/d2)/sum(1/d2)+0.5) AS BIGINT), CAST(floor(sum(g/d2)/sum(1/d2)+0.5) AS BIGINT), CAST(floor(sum(b/d2)/sum(1/d2)+0.5) AS BIGINT), 1 FROM near GROUP BY 1, 2")
def ortho_gaps(spark, d):
    r, q = F.col("row"), F.col("col")
    pixels = V.holed(spark, d).select("row", "col", (F.floor(F.col("z") * 5) % 256).alias("r"), (r * 7 % 256).alias("g"), (q * 9 % 256).alias("b"))
    return surface.fill_gaps(pixels, V.cells(spark, d).select("row", "col"), 2)


_PLACES = "m AS (SELECT l_suppkey a, l_partkey % 60 + l_tax xa, l_quantity + l_discount ya, l_suppkey % 40 + 1 b, l_orderkey % 50 + l_discount xb, l_quantity - l_tax yb FROM lineitem), s AS (SELECT a i, xa x, ya y FROM m UNION ALL SELECT b, xb, yb FROM m), p AS (SELECT i, CAST(floor(x*100+0.5) AS BIGINT) ix, CAST(floor(y*100+0.5) AS BIGINT) iy, min(x) x FROM s GROUP BY 1, 2, 3)"


@query(f"WITH {_PLACES} SELECT i image, row_number() OVER (PARTITION BY i ORDER BY iy, ix) - 1 AS kp, ix, iy FROM p")
def matched_places(spark, d):
    li = V.table(spark, d, "lineitem")
    s, x, t = F.col("l_suppkey"), F.col("l_discount") + 0.0, F.col("l_tax") + 0.0
    points = li.select(s.alias("image_a"), (F.col("l_partkey") % 60 + t).alias("xa"), (F.col("l_quantity") + x).alias("ya"), (s % 40 + 1).alias("image_b"), (F.col("l_orderkey") % 50 + x).alias("xb"), (F.col("l_quantity") - t).alias("yb"))
    keypoints, _ = imports.keypoints_of_points(points)
    grid = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("bigint")
    return keypoints.select("image", "kp", grid("x").alias("ix"), grid("y").alias("iy"))


_NODES = f"{V.POINTS}, n AS (SELECT 4 AS level, CAST(floor(x/8) AS BIGINT) nx, CAST(floor(y/8) AS BIGINT) ny, CAST(floor(z/8) AS BIGINT) nz, min(x) x0, min(y) y0, min(z) z0, max(x) x1, max(y) y1, max(z) z1 FROM points GROUP BY 1, 2, 3, 4)"


@query(f"WITH {_NODES}, u AS (SELECT *, unnest(range(5)) k FROM n) SELECT CAST(level - k AS INT) AS level, nx >> k AS nx, ny >> k AS ny, nz >> k AS nz, min(x0) x0, min(y0) y0, min(z0) z0, max(x1) x1, max(y1) y1, max(z1) z1, CAST(max(nx) AS DOUBLE) / 10 AS error, max(k = 0) AS content FROM u GROUP BY 1, 2, 3, 4")
def tile_boxes(spark, d):
    at = lambda c: F.floor(F.col(c) / 8).cast("bigint").alias(f"n{c}")
    nodes = V.points(spark, d).groupBy(F.lit(4).alias("level"), *[at(c) for c in "xyz"]).agg(*[f(c).alias(f"{c}{e}") for e, f in (("0", F.min), ("1", F.max)) for c in "xyz"])
    return lod.tile_bounds(nodes.withColumn("error", F.col("nx") / 10), 12)
