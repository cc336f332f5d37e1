"""Queries of column functions and small rules on the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from terrafold.functions import color, geom, text
from terrafold.operators import cloud, match, rules, select, survey
from terrafold.plans import views as V
from terrafold.plans.cloud_queries import r6
from terrafold.plans.register import Catalog

catalog = Catalog()
query = catalog.query

_ANGLE = "radians(s_suppkey % 360)"


@query(f"WITH c AS (SELECT s_suppkey id, cos({_ANGLE}) c, sin({_ANGLE}) s, s_suppkey % 7 + 0.5 a, s_suppkey % 11 - 3.0 b, s_suppkey % 13 + 20.0 h FROM supplier), p AS (SELECT *, -(c*a+s*b) cx, -(-s*a+c*b) cy, -h cz FROM c) SELECT id, round(cx,6) cx, round(cy,6) cy, round(cz,6) cz, round(c*(((100-320)/800.0*10)-a)+s*((50-240)/810.0*10-b),6) x, round(-s*((100-320)/800.0*10-a)+c*((50-240)/810.0*10-b),6) y, round(10-h,6) z, round(degrees(acos(greatest(-1.0,least(1.0,(cx*(cx-1)+cy*(cy-2)+cz*(cz-3))/(sqrt(cx*cx+cy*cy+cz*cz)*sqrt((cx-1)**2+(cy-2)**2+(cz-3)**2)))))),5) angle FROM p")
def camera_maths(spark, d):
    """Cameras turned about the vertical: their centre, a pixel's place, and the angle from the origin to them and a near place."""
    k = F.col("s_suppkey")
    c, s = F.cos(F.radians(k % 360)), F.sin(F.radians(k % 360))
    r = [c, -s, F.lit(0.0), s, c, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    t = (k % 7 + 0.5, k % 11 - 3.0, k % 13 + 20.0)
    lens = tuple(F.lit(v) for v in (800.0, 810.0, 320.0, 240.0))
    centre = geom.camera_centre(r, t)
    place = geom.unproject(r, t, lens, F.lit(100.0), F.lit(50.0), F.lit(10.0))
    zero = (F.lit(0.0), F.lit(0.0), F.lit(0.0))
    near = (centre[0] - 1, centre[1] - 2, centre[2] - 3)
    angle = geom.angle_at(centre, near, zero)
    rows = V.table(spark, d, "supplier")
    return rows.select(k.alias("id"), *[F.round(v, 6).alias(n) for v, n in zip((*centre, *place), ("cx", "cy", "cz", "x", "y", "z"), strict=True)], F.round(angle, 5).alias("angle"))


_XY = "p AS (SELECT c_custkey id, (c_custkey % 101 - 50) / 100.0 x, (c_custkey % 73 - 36) / 100.0 y FROM customer), q AS (SELECT *, x*x+y*y r2 FROM p)"


@query(f"WITH {_XY}, f AS (SELECT *, 1+r2*(-0.1+r2*(0.02+r2*-0.003)) radial, sqrt(r2) r, atan(sqrt(r2)) a FROM q), g AS (SELECT *, CASE WHEN r > 1e-12 THEN a*(1+a*a*(0.1+a*a*(0.01+a*a*(0.001+a*a*0.0001))))/r ELSE 1 END k FROM f) SELECT id, round(x*radial+2*0.001*x*y+0.002*(r2+2*x*x),9) bx, round(y*radial+0.001*(r2+2*y*y)+2*0.002*x*y,9) AS \"by\", round(x*k,9) fx, round(y*k,9) fy FROM g")
def lens_models(spark, d):
    k = F.col("c_custkey")
    x, y = (k % 101 - 50) / 100.0, (k % 73 - 36) / 100.0
    bx, by = geom.distort(x, y, -0.1, 0.02, -0.003, 0.001, 0.002)
    fx, fy = geom.distort_fisheye(x, y, (0.1, 0.01, 0.001, 0.0001))
    return V.table(spark, d, "customer").select(k.alias("id"), *[F.round(v, 9).alias(n) for v, n in ((bx, "bx"), (by, "by"), (fx, "fx"), (fy, "fy"))])


_OPK = "o AS (SELECT c_custkey id, radians(c_custkey % 120 - 60) o, radians(c_custkey % 77 - 38) p, radians(c_custkey % 340 - 170) k FROM customer), m AS (SELECT id, cos(p)*cos(k) m0, cos(o)*sin(k)+sin(o)*sin(p)*cos(k) m1, sin(o)*sin(k)-cos(o)*sin(p)*cos(k) m2, -cos(p)*sin(k) m3, cos(o)*cos(k)-sin(o)*sin(p)*sin(k) m4, sin(o)*cos(k)+cos(o)*sin(p)*sin(k) m5, sin(p) m6, -sin(o)*cos(p) m7, cos(o)*cos(p) m8 FROM o)"


@query(f"WITH {_OPK} SELECT id, id % 120 - 60.0 AS omega, id % 77 - 38.0 AS phi, id % 340 - 170.0 AS kappa, round(sqrt(greatest(0, 1+m0+m4+m8))/2, 7) qw FROM m")
def angle_systems(spark, d):
    """Omega, phi, kappa through a matrix and a quaternion, and back."""
    k = F.col("c_custkey")
    m = geom.opk_matrix(k % 120 - 60, k % 77 - 38, k % 340 - 170)
    q = geom.quaternion(m)
    back = geom.opk_from_matrix(geom.rotation_of(*q))
    return V.table(spark, d, "customer").select(k.alias("id"), *[(F.round(v, 6) + 0.0).alias(n) for v, n in zip(back, ("omega", "phi", "kappa"), strict=True)], F.round(q[0], 7).alias("qw"))


_LL = "p AS (SELECT c_custkey id, (c_custkey*37 % 3599)/10.0-180 lon, (c_custkey*53 % 1600)/10.0-80 lat FROM customer)"


@query(f"WITH {_LL} SELECT id, round(lon, 6) lon, round(lat, 6) lat, 100.0 AS h, round((lon+180)/360*1024, 5) tx, round(((lon+180)/360*1024)/1024*360-180, 6) back, round((lon*1000-5)/0.9996, 5) gx FROM p")
def place_round_trips(spark, d):
    """Places through geocentric, tile and local coordinates, and back."""
    k = F.col("c_custkey")
    lon, lat = (k * 37 % 3599) / 10.0 - 180, (k * 53 % 1600) / 10.0 - 80
    again = geom.ecef_to_geodetic(*geom.geodetic_to_ecef(lon, lat, F.lit(100.0)))
    tx, ty = geom.lonlat_to_tile(lon, lat, 10)
    back, _ = geom.tile_to_lonlat(tx, ty, 10)
    gx, _ = geom.grid_to_local(lon * 1000, lat * 1000, (5.0, 7.0), 0.9996)
    out = [(again[0], "lon", 6), (again[1], "lat", 6), (again[2], "h", 4), (tx, "tx", 5), (back, "back", 6), (gx, "gx", 5)]
    return V.table(spark, d, "customer").select(k.alias("id"), *[(F.round(v, n) + 0.0).alias(c) for v, c, n in out])


@query("WITH m AS (SELECT l_suppkey id_a, l_partkey % 50 kp_a, l_suppkey % 40 + 1 id_b, l_orderkey % 60 - 2 kp_b FROM lineitem), n AS (SELECT s_suppkey id, 20 + s_suppkey % 30 AS n FROM supplier) SELECT id_a, id_b, count(*) kept FROM m JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b WHERE kp_a >= 0 AND kp_b >= 0 AND kp_a < a.n AND kp_b < b.n GROUP BY 1, 2")
def valid_indices(spark, d):
    s = F.col("l_suppkey")
    matches = V.table(spark, d, "lineitem").select(s.alias("id_a"), (F.col("l_partkey") % 50).alias("kp_a"), (s % 40 + 1).alias("id_b"), (F.col("l_orderkey") % 60 - 2).alias("kp_b"))
    counts = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), (20 + F.col("s_suppkey") % 30).alias("n"))
    return select.valid_matches(matches, counts).groupBy("id_a", "id_b").agg(F.count(F.lit(1)).alias("kept"))


_RAYS = "o AS (SELECT l_orderkey pt, l_suppkey image_id, min(l_tax)*40 AS error, min(l_quantity) - 4.0 AS depth, radians(l_suppkey % 50) AS w FROM lineitem GROUP BY 1, 2, 5)"


def _rays(spark, d):
    o = V.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pt"), F.col("l_suppkey").alias("image_id")).agg((F.min("l_tax") * 40.0).alias("error"), (F.min("l_quantity") - 4.0).alias("depth"))
    w = F.radians(F.col("image_id") % 50)
    return o.withColumns({"dx": F.sin(w), "dy": F.lit(0.0), "dz": F.cos(w)})


@query(f"WITH {_RAYS}, g AS (SELECT * FROM o WHERE depth > 0 AND error <= 2.5), w AS (SELECT a.pt FROM g a JOIN g b ON a.pt = b.pt AND a.image_id < b.image_id GROUP BY 1 HAVING round(max(degrees(acos(greatest(-1.0,least(1.0,sin(a.w)*sin(b.w)+cos(a.w)*cos(b.w)))))), 6) >= 20.5) SELECT pt, count(*) n FROM g WHERE pt IN (SELECT pt FROM w) GROUP BY 1")
def track_gates(spark, d):
    return select.filter_tracks(_rays(spark, d), 2.5, 20.5).groupBy("pt").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_RAYS}, s AS (SELECT a.image_id, b.image_id AS source, count(*) shared FROM o a JOIN o b ON a.pt = b.pt AND a.image_id <> b.image_id WHERE round(degrees(acos(greatest(-1.0,least(1.0,sin(a.w)*sin(b.w)+cos(a.w)*cos(b.w))))), 6) BETWEEN 2.5 AND 30.5 GROUP BY 1, 2), k AS (SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, source) AS INT) AS rank, source, shared FROM s) SELECT * FROM k WHERE rank <= 8")
def depth_sources(spark, d):
    o = _rays(spark, d)
    return survey.source_views(o.select("pt", "image_id"), o.select("pt", "image_id", "dx", "dy", "dz"), 2.5, 30.5, 8)


@query("SELECT count(*) FILTER (l_tax > 0.05) errors, count(*) FILTER (l_quantity < 5) short FROM lineitem")
def gradual_selection(spark, d):
    m = V.table(spark, d, "lineitem").select((F.col("l_tax") + 0.0).alias("error"), F.col("l_quantity").cast("double").alias("length"))
    over = select.select_sparse(m, "error", 0.05).agg(F.count(F.lit(1)).alias("errors"))
    return over.join(select.select_sparse(m, "length", 5.0).agg(F.count(F.lit(1)).alias("short")))


_PIXELS = f"{V.CELLS}, px AS (SELECT 1 AS map_id, col AS u, row AS v, CASE WHEN (row*5+col*3) % 7 = 0 THEN 0 ELSE z + 30 END AS depth FROM cells)"


@query(f"WITH {_PIXELS}, ok AS (SELECT * FROM px WHERE depth > 0), n AS (SELECT a.u, a.v, count(*) n FROM ok a JOIN ok b ON abs(a.u-b.u) <= 1 AND abs(a.v-b.v) <= 1 AND NOT (a.u=b.u AND a.v=b.v) AND abs(b.depth-a.depth) <= 0.02*a.depth GROUP BY 1, 2) SELECT ok.u, ok.v FROM ok JOIN n USING (u, v) WHERE n >= 3")
def depth_speckles(spark, d):
    depth = F.when((F.col("row") * 5 + F.col("col") * 3) % 7 == 0, 0.0).otherwise(F.col("z") + 30)
    pixels = V.cells(spark, d).select(F.lit(1).alias("map_id"), F.col("col").alias("u"), F.col("row").alias("v"), depth.alias("depth"))
    return select.speckle_filter(pixels, 0.02, 3).select("u", "v")


@query(f"WITH {V.CELLS} SELECT CAST((row*3+col) % 5 AS BIGINT) AS label, count(*) * 16.0 AS area FROM cells GROUP BY 1")
def label_areas(spark, d):
    c = V.cells(spark, d).withColumn("label", (F.col("row") * 3 + F.col("col")) % 5)
    return select.label_areas(c, 4.0)


@query(f"WITH {V.POINTS}, n AS (SELECT CAST(floor(log2(1 + pid % 1000)) AS BIGINT) AS level, pid % 64 AS node, count(*) AS c FROM points GROUP BY 1, 2), t AS (SELECT level, sum(c) s, min(100.0 / pow(2, level)) sp FROM n GROUP BY 1), r AS (SELECT level, sp, sum(s) OVER (ORDER BY level) run FROM t) SELECT level, count(*) nodes, CAST(sum(c) AS BIGINT) points FROM n WHERE level IN (SELECT level FROM r WHERE run <= 20000 AND sp >= 0.5) GROUP BY 1")
def level_budget(spark, d):
    p = V.points(spark, d)
    nodes = p.groupBy(F.floor(F.log2(1 + F.col("pid") % 1000)).alias("level"), (F.col("pid") % 64).alias("node")).agg(F.count(F.lit(1)).alias("count")).withColumn("spacing", 100.0 / F.pow(F.lit(2.0), F.col("level")))
    return select.extract_levels(nodes, 20_000, 0.5).groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("count").alias("points"))


@query("WITH t AS (SELECT l_suppkey tile, count(*) FILTER (l_returnflag <> 'R') inliers, count(*) n, least(max(l_partkey % 100) FILTER (l_returnflag <> 'R') - min(l_partkey % 100) FILTER (l_returnflag <> 'R'), max(l_orderkey % 100) FILTER (l_returnflag <> 'R') - min(l_orderkey % 100) FILTER (l_returnflag <> 'R')) side FROM lineitem GROUP BY 1) SELECT tile, inliers, n FROM t WHERE inliers >= 10 AND inliers >= 0.65*n AND side >= 20")
def tile_gate(spark, d):
    li = V.table(spark, d, "lineitem")
    tiles = li.select(F.col("l_suppkey").alias("tile"), (F.col("l_partkey") % 100).alias("x"), (F.col("l_orderkey") % 100).alias("y"), (F.col("l_returnflag") != "R").alias("inlier"))
    return rules.accept_tile(tiles, 100.0, 10, 0.65, 0.2).select("tile", "inliers", "n")


@query(f"WITH {V.POINTS}, c AS (SELECT s_suppkey image_id, (s_suppkey*37 % 101)::DOUBLE cx, (s_suppkey*53 % 101)::DOUBLE cy, 55.0 + s_suppkey % 9 cz FROM supplier) SELECT image_id, count(*) n FROM points p JOIN c ON abs(cx-x) <= 25*sqrt(3)+1 AND abs(cy-y) <= 25*sqrt(3)+1 WHERE cz-z > 0 AND cz-z <= 20 AND round(degrees(atan2(sqrt((cx-x)**2+(cy-y)**2), cz-z)), 9) <= 35.001 GROUP BY 1")
def cone_visibility(spark, d):
    k = F.col("s_suppkey")
    cameras = V.table(spark, d, "supplier").select(k.alias("image_id"), (k * 37 % 101).cast("double").alias("x"), (k * 53 % 101).cast("double").alias("y"), (55.0 + k % 9).alias("z"))
    return rules.visible_counts(V.points(spark, d), cameras, 20.0, 35.001)


@query(f"WITH {V.POINTS}, a AS (SELECT pid AS pt, round(z - (r % 50), 6) dz, b % 6 AS views FROM points WHERE r % 3 > 0), k AS (SELECT *, row_number() OVER (ORDER BY views DESC, abs(dz), pt) rn FROM a WHERE views >= 3) SELECT pt, dz, 0.25 AS weight FROM k WHERE rn <= 2000")
def height_anchors(spark, d):
    p = V.points(spark, d)
    points = p.select(F.col("pid").alias("pt"), "z", (F.col("b") % 6).alias("views"))
    heights = p.where("r % 3 > 0").select(F.col("pid").alias("id"), (F.col("r") % 50).cast("double").alias("z"))
    return rules.dem_anchors(points, heights).withColumns(r6("dz"))


@query("WITH a AS (SELECT l_suppkey % 5 map_id, l_partkey % 40 u, l_orderkey % 40 v, count(DISTINCT l_suppkey) n FROM lineitem GROUP BY 1, 2, 3), o AS (SELECT unnest(range(5)) map_id) SELECT a.map_id, u, v FROM a JOIN o USING (map_id) WHERE n >= greatest(1, least(3, 1 + a.map_id))")
def agreeing_views(spark, d):
    s = F.col("l_suppkey")
    agreement = V.table(spark, d, "lineitem").select((s % 5).alias("map_id"), (F.col("l_partkey") % 40).alias("u"), (F.col("l_orderkey") % 40).alias("v"), s.alias("other"))
    overlapping = spark.range(5).select(F.col("id").alias("map_id"), (1 + F.col("id")).alias("views"))
    return rules.consistent_views(agreement, overlapping, 3)


_KEYS = "k AS (SELECT l_suppkey image_id, l_orderkey*8+l_linenumber kp, min(l_partkey % 200) x, min(l_orderkey % 150) y, min(l_extendedprice) response FROM lineitem GROUP BY 1, 2)"


@query(f"WITH {_KEYS}, t AS (SELECT *, row_number() OVER (PARTITION BY image_id, least(3, floor(x*4/200.0)), least(3, floor(y*4/150.0)) ORDER BY response DESC, kp) turn FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY turn, response DESC, kp) rn FROM t) SELECT image_id, kp FROM r WHERE rn <= 12")
def spread_keypoints(spark, d):
    li = V.table(spark, d, "lineitem")
    k = li.groupBy(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kp")).agg(F.min(F.col("l_partkey") % 200).alias("x"), F.min(F.col("l_orderkey") % 150).alias("y"), F.min("l_extendedprice").alias("response"))
    return rules.spread_subset(k, 4, 200.0, 150.0, 12).select("image_id", "kp")


@query(f"WITH {V.POINTS} SELECT CAST(r >= 128 AND g >= 128 AS BOOLEAN) AS hidden, NOT (r >= 128 AND g >= 128) AS shown, count(*) n FROM points GROUP BY 1, 2")
def mask_rules(spark, d):
    p = V.points(spark, d)
    return p.groupBy(rules.mask_algebra(F.col("r"), F.col("g")).alias("hidden"), rules.mask_algebra(F.col("r"), F.col("g"), True).alias("shown")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V.POINTS}, w AS (SELECT pid, z + 60 AS w, (2*x - 100) / (z + 60) AS u, (2*y - 100) / (z + 60) AS v FROM points) SELECT count(*) inside, (SELECT arg_min(pid, (round(w / w, 9), pid)) FROM w WHERE abs(u - 0.1) <= 0.2 AND abs(v) <= 0.2) AS picked, (SELECT max(greatest(abs(x), abs(y), abs(z))) FROM points) AS most FROM w WHERE u > -0.505 AND u < 0.495 AND v > -0.505 AND v < 0.495")
def screen_rules(spark, d):
    """A lasso and a pick in the picture of a camera above, and the largest coordinate."""
    eye = [[2.0, 0.0, 0.0, -100.0], [0.0, 2.0, 0.0, -100.0], [0.0, 0.0, 1.0, 60.0], [0.0, 0.0, 1.0, 60.0]]
    p = V.points(spark, d)
    ring = [(-0.505, -0.505), (0.495, -0.505), (0.495, 0.495), (-0.505, 0.495)]
    inside = survey.screen_select(p, eye, [ring], edge=False).agg(F.count(F.lit(1)).alias("inside"))
    parts = [inside, rules.pick_nearest(p, eye, (0.1, 0.0), (0.2, 0.2)).withColumnRenamed("pid", "picked"), rules.max_abs(p)]
    return reduce(lambda a, b: a.join(b), parts)  # one row each


@query(f"WITH {V.POINTS} SELECT pid, round(x*0.3048, 6) x, round(-z*0.3048, 6) y, round(y*0.3048, 6) z FROM points")
def unit_import(spark, d):
    return survey.import_transform(V.points(spark, d).select("pid", "x", "y", "z"), 0.3048, True).withColumns(r6("x", "y", "z"))


_STOPS = [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)]


def _ramp(c: int) -> str:
    table = "[" + ", ".join(f"{s[c]}.0" for s in _STOPS) + "]"
    return f"CAST(floor({table}[k+1] + ({table}[k+2] - {table}[k+1]) * (a - k) + 0.5) AS INT)"


@query(f"WITH {V.CELLS}, t AS (SELECT row, col, greatest(0.0, least(1.0, (z - 20) / 10)) * 4 AS a FROM cells), s AS (SELECT *, CAST(least(floor(a), 3) AS BIGINT) k FROM t) SELECT row, col, {_ramp(0)} r, {_ramp(1)} g, {_ramp(2)} b FROM s")
def colour_ramp(spark, d):
    r, g, b = color.ramp((F.col("z") - 20) / 10, "viridis")
    return V.cells(spark, d).select("row", "col", r.alias("r"), g.alias("g"), b.alias("b"))


@query("SELECT s_suppkey id, round(pi() / (100 + s_suppkey % 50), 9) sun, round(0.5 / (2 + s_suppkey % 7), 9) panel, concat_ws('-', CAST(s_suppkey % 5 AS VARCHAR), CAST(s_suppkey AS VARCHAR), '0', '7') AS key, '1/' || (s_suppkey % 9 + 1) AS tag, round(1.0 / (s_suppkey % 9 + 1), 9) AS number, 'roll' || s_suppkey % 4 AS roll, s_suppkey AS frame FROM supplier")
def name_and_number_rules(spark, d):
    k = F.col("s_suppkey")
    name = F.concat(F.lit("roll"), (k % 4).cast("string"), F.lit("_"), k.cast("string"), F.lit(".tif"))
    roll, frame = text.roll_and_number(name)
    tag = F.concat(F.lit("1/"), (k % 9 + 1).cast("string"))
    sun, panel = color.reflectance_factor(irradiance=100.0 + k % 50), color.reflectance_factor(panel_albedo=0.5, panel_radiance=2.0 + k % 7)
    return V.table(spark, d, "supplier").select(k.alias("id"), F.round(sun, 9).alias("sun"), F.round(panel, 9).alias("panel"), text.node_key(k % 5, k, F.lit(0), F.lit(7)).alias("key"), tag.alias("tag"), F.round(text.tag_number(tag), 9).alias("number"), roll.alias("roll"), frame.cast("bigint").alias("frame"))


@query("WITH f AS (SELECT s_suppkey id, (s_suppkey % 100)::DOUBLE cx, (s_suppkey * 7 % 100)::DOUBLE cy, 50.0 + s_suppkey % 10 h FROM supplier) SELECT id, corner, round(cx + (CASE WHEN corner IN (0, 3) THEN -320 ELSE 320 END) / 800.0 * h, 6) x, round(cy - (CASE WHEN corner < 2 THEN -240 ELSE 240 END) / 800.0 * h, 6) y FROM f, (SELECT unnest(range(4)) corner)")
def ground_footprints(spark, d):
    k = F.col("s_suppkey")
    down = [F.lit(float(v)) for v in (1, 0, 0, 0, -1, 0, 0, 0, -1)]
    centre = ((k % 100).cast("double"), (k * 7 % 100).cast("double"), F.lit(50.0) + k % 10)
    lens = tuple(F.lit(v) for v in (800.0, 800.0, 320.0, 240.0))
    rings = V.table(spark, d, "supplier").select(k.alias("id"), survey.footprint(down, centre, lens, F.lit(640.0), F.lit(480.0), F.lit(0.0)).alias("p"))
    return rings.select("id", F.posexplode("p").alias("corner", "q")).select("id", F.col("corner").cast("bigint").alias("corner"), F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y"))


@query(f"WITH {V.HOLED}, t AS (SELECT id // 30 AS row, id % 30 AS col, (id % 30 + 0.5) * 3.0 + 5 AS x, 100.0 - (id // 30 + 0.5) * 3.0 AS y FROM range(900) t(id)), f AS (SELECT row, col, (x+2)/4-0.5 fc, (104.0-(y-1))/4-0.5 fr FROM t), v AS (SELECT row, col, fc-floor(fc) tx, fr-floor(fr) ty, (SELECT z FROM holed n WHERE n.row=CAST(floor(fr) AS BIGINT) AND n.col=CAST(floor(fc) AS BIGINT)) v00, (SELECT z FROM holed n WHERE n.row=CAST(floor(fr) AS BIGINT) AND n.col=CAST(floor(fc) AS BIGINT)+1) v01, (SELECT z FROM holed n WHERE n.row=CAST(floor(fr) AS BIGINT)+1 AND n.col=CAST(floor(fc) AS BIGINT)) v10, (SELECT z FROM holed n WHERE n.row=CAST(floor(fr) AS BIGINT)+1 AND n.col=CAST(floor(fc) AS BIGINT)+1) v11 FROM f) SELECT row, col, round(coalesce((v00*(1-tx)+v01*tx)*(1-ty)+(v10*(1-tx)+v11*tx)*ty, CASE WHEN ty >= 0.5 THEN CASE WHEN tx >= 0.5 THEN v11 ELSE v10 END ELSE CASE WHEN tx >= 0.5 THEN v01 ELSE v00 END END, v00, v01, v10, v11),6) z FROM v")
def warped_heights(spark, d):
    cells = spark.range(900).select(F.floor(F.col("id") / 30).alias("row"), (F.col("id") % 30).alias("col"))
    target = cells.withColumns({"x": (F.col("col") + 0.5) * 3.0 + 5, "y": 100.0 - (F.col("row") + 0.5) * 3.0})
    return survey.warp(V.holed(spark, d), target, lambda x, y: (x + 2, y - 1), 4.0, 0.0, 104.0).withColumns(r6("z"))


@query("WITH p AS (SELECT s_suppkey image_id, s_suppkey * 13 % 40 AS n FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY n, image_id) rn FROM p WHERE n < 2*8) SELECT image_id, n FROM k WHERE rn <= 10")
def thin_margins(spark, d):
    k = F.col("s_suppkey")
    photos = V.table(spark, d, "supplier").select(k.alias("image_id"), (k * 13 % 40).alias("correspondences"))
    return rules.thin_margin(photos, 8).select("image_id", F.col("correspondences").alias("n"))


@query("WITH s AS (SELECT s_suppkey uuid, 'k' || s_suppkey % 7 AS key, [s_suppkey % 3, 5] AS camera_keys FROM supplier), w AS (SELECT s_suppkey uuid, 'k' || s_suppkey % 5 AS key, [s_suppkey % 2, 5] AS camera_keys FROM supplier) SELECT s.uuid FROM s JOIN w ON s.uuid = w.uuid AND s.key = w.key AND s.camera_keys = w.camera_keys")
def reusable_outputs(spark, d):
    k = F.col("s_suppkey")
    of = lambda a, b: V.table(spark, d, "supplier").select(k.alias("uuid"), F.concat(F.lit("k"), (k % a).cast("string")).alias("key"), F.array(k % b, F.lit(5).cast("bigint")).alias("camera_keys"))
    return rules.reusable(of(7, 3), of(5, 2)).select("uuid")


@query("WITH r AS (SELECT a.vec_id id, row_number() OVER (PARTITION BY a.vec_id ORDER BY b.vec_id) AS rank, b.vec_id other FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 OR b.vec_id = a.vec_id * 2 WHERE a.vec_id <> b.vec_id) SELECT DISTINCT least(id, other) id_a, greatest(id, other) id_b FROM r")
def mirrored_pairs(spark, d):
    v = V.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    steps = v.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") * 2)).alias("other")).where("id <> other")
    return match.symmetric_pairs(steps.join(v.select(F.col("id").alias("other")), "other"))


@query("SELECT id, part FROM (SELECT s_suppkey id, ntile(7) OVER (ORDER BY s_suppkey) - 1 AS part FROM supplier)")
def near_equal_parts(spark, d):
    items = V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return rules.chunks(items, 7, "id").select("id", F.col("part").cast("bigint").alias("part"))


@query(f"WITH {V.POINTS}, s AS (SELECT pid FROM points WHERE (pid * 7) % 5 < 2) SELECT (SELECT count(*) FROM points JOIN s USING (pid)) kept, (SELECT count(*) FROM points WHERE pid NOT IN (SELECT pid FROM s)) gone")
def masked_points(spark, d):
    p = V.points(spark, d)
    chosen = p.where("(pid * 7) % 5 < 2").select("pid")
    count = lambda keep, name: cloud.mask_cloud(p, chosen, keep).agg(F.count(F.lit(1)).alias(name))
    return count(True, "kept").join(count(False, "gone"))  # one row each
