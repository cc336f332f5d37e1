"""Selections, file joins, meshes and small rules on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.functions import color, geom, text
from terrafold.functions import stats as S
from terrafold.operators import cloud as C
from terrafold.operators import evaluate as E
from terrafold.operators import kernels as K
from terrafold.operators import mesh
from terrafold.operators import raster as R
from terrafold.operators import select as X
from terrafold.plans import views as V
from terrafold.plans.register import Catalog

catalog = Catalog()
query = catalog.query

_MOVES = "m AS (SELECT l_orderkey*8+l_linenumber k, l_partkey % 50 xa, l_suppkey % 50 ya, l_partkey % 50 + l_quantity % 7 xb, l_suppkey % 50 + l_linenumber yb FROM lineitem)"


@query(f"WITH {_MOVES} SELECT xb - xa dx, yb - ya dy, count(*) n FROM m WHERE (xa-xb)**2+(ya-yb)**2 > 20 GROUP BY 1, 2")
def moving_matches(spark, d):
    li = V.table(spark, d, "lineitem")
    x, y = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    m = li.select(x.alias("xa"), y.alias("ya"), (x + F.col("l_quantity") % 7).alias("xb"), (y + F.col("l_linenumber")).alias("yb"))
    return X.moving_matches(m, 20**0.5).groupBy((F.col("xb") - F.col("xa")).alias("dx"), (F.col("yb") - F.col("ya")).alias("dy")).agg(F.count(F.lit(1)).alias("n"))


_PX = V.EDGES + ", p AS (SELECT id_a, id_b, inliers, (id_a*7 + id_b*13) % 11 + CASE WHEN id_a % 17 = 3 OR id_b % 17 = 3 THEN 20.0 ELSE 0.5 END px FROM edges), e AS (SELECT id_a i, id_b o, inliers, px FROM p UNION ALL SELECT id_b, id_a, inliers, px FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY inliers DESC, o) k FROM e), s AS (SELECT i, list_sort(list(px))[count(*)//2+1] err FROM r WHERE k <= 5 GROUP BY 1), t AS (SELECT list_sort(list(err))[count(*)//2+1] typ FROM s)"


@query(f"WITH {_PX} SELECT i image_id, err \"error\", err > greatest(typ*2.0, 2.0) flagged FROM s, t")
def registration_outliers(spark, d):
    e = V.edges(spark, d)
    px = (F.col("id_a") * 7 + F.col("id_b") * 13) % 11 + F.when((F.col("id_a") % 17 == 3) | (F.col("id_b") % 17 == 3), 20.0).otherwise(0.5)
    return X.registration_outliers(e.withColumn("median_px", px), factor=2.0)


@query("SELECT kp, canonical FROM (SELECT l_orderkey*8+l_linenumber kp, min(l_orderkey*8+l_linenumber) OVER (PARTITION BY l_suppkey, l_partkey % 20, l_quantity, l_linenumber % 2) canonical FROM lineitem) GROUP BY ALL")
def canonical_siblings(spark, d):
    k = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("kp"), (F.col("l_partkey") % 20).alias("x"), F.col("l_quantity").alias("y"), (F.col("l_linenumber") % 2).alias("scale"))
    return X.canonical_siblings(k).select("kp", "canonical").distinct()


@query("WITH i AS (SELECT c_custkey id, lower(trim(c_mktsegment)) make, c_nationkey model FROM customer) SELECT id image_id, min(id) OVER (PARTITION BY make, model) sensor FROM i")
def sensor_groups(spark, d):
    i = V.table(spark, d, "customer").select(F.col("c_custkey").alias("image_id"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("make"), F.col("c_nationkey").cast("string").alias("model"), F.lit(8.8).alias("focal"), F.lit(4000).alias("width"), F.lit(3000).alias("height"))
    return X.sensor_groups(i)


@query("WITH i AS (SELECT o_orderkey id, o_custkey capture, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) band FROM orders), f AS (SELECT capture, min_by(id, band) reference FROM i GROUP BY 1 HAVING count(*) > 1) SELECT capture, reference, id image_id, band FROM i JOIN f USING (capture)")
def rig_members(spark, d):
    from pyspark.sql import Window

    o = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("capture"))
    return X.rigs(o.withColumn("band", F.row_number().over(Window.partitionBy("capture").orderBy("image_id")).cast("bigint")))


@query(f"WITH {V.CELLS}, l AS (SELECT row, col, CAST(floor(z/5) AS BIGINT) \"label\" FROM cells), c AS (SELECT a.row, a.col, b.label, count(*) n FROM l a JOIN l b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 GROUP BY 1,2,3), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY n DESC, label) k FROM c) SELECT row, col, label FROM r WHERE k = 1")
def label_majority(spark, d):
    return X.majority(V.cells(spark, d).withColumn("label", F.floor(F.col("z") / 5)))


_GAP = V.CELLS + ", dense AS (SELECT * FROM cells WHERE (row * 7 + col * 3) % 5 <> 0 AND NOT (row BETWEEN 8 AND 11 AND col BETWEEN 8 AND 14) AND NOT (row < 3 AND col > 20)), b AS (SELECT min(row) r0, max(row) r1, min(col) c0, max(col) c1 FROM dense), box AS (SELECT r AS row, c AS col FROM b, range(0,27) x(r), range(0,27) y(c) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1), gap AS (SELECT * FROM box ANTI JOIN dense USING (row, col)), outer_ AS (SELECT row, col FROM gap, b WHERE row IN (r0, r1) OR col IN (c0, c1) UNION SELECT g.row, g.col FROM outer_ o JOIN gap g ON abs(g.row-o.row)+abs(g.col-o.col) = 1)"


@query(f"WITH RECURSIVE {_GAP} SELECT row, col FROM gap ANTI JOIN outer_ USING (row, col)")
def enclosed_gaps(spark, d):
    r, c = F.col("row"), F.col("col")
    dense = V.cells(spark, d).where(((r * 7 + c * 3) % 5 != 0) & ~(r.between(8, 11) & c.between(8, 14)) & ~((r < 3) & (c > 20)))
    return X.enclosed(dense)


@query(f"WITH {V.CELLS}, t AS (SELECT 5 z, col x, row y, z \"value\" FROM cells), a AS (SELECT 4 z, x//2 x, y//2 y, avg(value) \"value\" FROM t GROUP BY 2,3), b AS (SELECT 3 z, x//2 x, y//2 y, avg(value) \"value\" FROM a GROUP BY 2,3) SELECT z, x, y, round(value,6) \"value\" FROM (SELECT * FROM t UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b)")
def tile_pyramid(spark, d):
    tiles = V.cells(spark, d).select(F.lit(5).alias("z"), F.col("col").alias("x"), F.col("row").alias("y"), F.col("z").alias("value"))
    return X.tile_pyramid(tiles, 2).withColumn("value", F.round("value", 6))


_MARKS = "m AS (SELECT l_suppkey g, l_partkey % 97 / 10.0 X, l_quantity / 5.0 Y, 2*(l_partkey % 97 / 10.0) - 0.5*(l_quantity / 5.0) + l_linenumber / 10.0 px FROM lineitem), s AS (SELECT g, count(*) n, var_pop(X) xx, var_pop(Y) yy, covar_pop(X,Y) xy, covar_pop(X,px) xu, covar_pop(Y,px) yu FROM m GROUP BY 1)"


@query(f"WITH {_MARKS} SELECT g, n, round((xu*yy-yu*xy)/(xx*yy-xy*xy),6) a, round((yu*xx-xu*xy)/(xx*yy-xy*xy),6) b FROM s")
def affine_fit(spark, d):
    x, y = F.col("l_partkey") % 97 / 10.0, F.col("l_quantity") / 5.0
    m = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), x.alias("X"), y.alias("Y"), (2 * x - 0.5 * y + F.col("l_linenumber") / 10.0).alias("px"), y.alias("py"))
    return X.affine_fit(m, ["g"]).select("g", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


_DEPTH = f"{V.POINTS}, p AS (SELECT b % 5 map_id, x, y, z, 20 + z/10 AS depth, floor(x/8) ix, floor(y/8) iy, floor(z/8) iz FROM points), m AS (SELECT map_id, ix, iy, iz, quantile_cont(depth, 0.5) m FROM p GROUP BY ALL), n AS (SELECT p.* FROM p JOIN m USING (map_id, ix, iy, iz) WHERE abs(depth - m) <= 0.01 * m)"


@query(f"WITH {_DEPTH} SELECT CAST(ix AS BIGINT) ix, CAST(iy AS BIGINT) iy, CAST(iz AS BIGINT) iz, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z, count(DISTINCT map_id) \"views\" FROM n GROUP BY 1,2,3 HAVING count(DISTINCT map_id) >= 3")
def fuse_depths(spark, d):
    p = V.points(spark, d).select((F.col("b") % 5).alias("map_id"), "x", "y", "z", (20 + F.col("z") / 10).alias("depth"))
    return X.fuse_depths(p, 8.0, 3, 0.01).select("ix", "iy", "iz", *[F.round(c, 6).alias(c) for c in "xyz"], "views")


@query(f"WITH {V.POINTS} SELECT b % 5 map_id, round(count(*) FILTER (z > 3) / count(*), 6) valid, min(z) FILTER (z > 3) - 3 nearest, max(z) FILTER (z > 3) - 3 farthest, round(quantile_cont(x, 0.5) FILTER (z > 3), 6) \"cost\", round(quantile_cont(x, 0.95) FILTER (z > 3), 6) cost_p95 FROM points GROUP BY 1")
def depth_stats(spark, d):
    p = V.points(spark, d).select((F.col("b") % 5).alias("map_id"), (F.col("z") - 3).alias("depth"), F.col("x").alias("cost"))
    out = X.depth_stats(p, ["map_id"])
    return out.select("map_id", F.round("valid", 6).alias("valid"), "nearest", "farthest", F.round("cost", 6).alias("cost"), F.round("cost_p95", 6).alias("cost_p95"))


_MESH = "tri AS (SELECT l_orderkey*8+l_linenumber tid, l_partkey % 300 v0, l_suppkey % 300 + 300 v1, l_orderkey % 300 v2 FROM lineitem), e AS (SELECT least(v0,v1) a, greatest(v0,v1) b, tid FROM tri UNION ALL SELECT least(v1,v2), greatest(v1,v2), tid FROM tri UNION ALL SELECT least(v2,v0), greatest(v2,v0), tid FROM tri), p AS (SELECT a, b, count(*) n FROM e WHERE a <> b GROUP BY 1,2)"


def _triangles(spark, d):
    li = V.table(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tid"), (F.col("l_partkey") % 300).alias("v0"), (F.col("l_suppkey") % 300 + 300).alias("v1"), (F.col("l_orderkey") % 300).alias("v2"))


@query(f"WITH {_MESH} SELECT count(*) edges, count(*) FILTER (n = 1) boundary, count(*) FILTER (n > 2) non_manifold, count(*) > 0 AND count(*) FILTER (n = 1) = 0 AND count(*) FILTER (n > 2) = 0 watertight FROM p")
def mesh_topology(spark, d):
    return mesh.topology(_triangles(spark, d))


@query(f"WITH {V.CELLS}, t AS (SELECT a.z za, b.z zb, c.z zc FROM cells a JOIN cells b ON b.row=a.row AND b.col=a.col+1 JOIN cells c ON c.row=a.row+1 AND c.col=a.col) SELECT count(*) triangles, round(sum(sqrt((4*(zb-za))**2+(4*(zc-za))**2+256)/2),3) area FROM t")
def mesh_measure(spark, d):
    c = V.cells(spark, d)
    vid = lambda r, q: r * 1000 + q
    r, q = F.col("row"), F.col("col")
    vertices = c.select(vid(r, q).alias("vid"), (q * 4.0).alias("x"), (r * 4.0).alias("y"), "z")
    corner = lambda dr, dq: c.select((r - dr).alias("row"), (q - dq).alias("col"))
    t = c.select("row", "col").join(corner(0, 1), ["row", "col"]).join(corner(1, 0), ["row", "col"]).select(vid(r, q).alias("tid"), vid(r, q).alias("v0"), vid(r, q + 1).alias("v1"), vid(r + 1, q).alias("v2"))
    return mesh.measure(vertices, t).select("triangles", F.round("area", 3).alias("area"))


@query(f"WITH {V.CELLS}, d AS (SELECT a.row, a.col, a.z - b.z dz FROM cells a LEFT JOIN cells b ON b.row = a.row AND b.col = a.col + 1) SELECT count(*) cells, count(dz) measured, round(avg(dz),6) mean, round(stddev_samp(dz),6) sd FROM d")
def dem_compare(spark, d):
    c = V.cells(spark, d)
    out = R.compare(c, c.withColumn("col", F.col("col") - 1))
    return out.agg(F.count(F.lit(1)).alias("cells"), F.count("dz").alias("measured"), F.round(F.avg("dz"), 6).alias("mean"), F.round(F.stddev_samp("dz"), 6).alias("sd"))


@query("SELECT c_custkey id, CASE WHEN c_nationkey % 5 = 0 THEN 'no keypoints' WHEN c_custkey % 4 = 0 THEN 'no matches' WHEN c_custkey % 3 = 0 THEN 'apart from the main block' WHEN c_custkey % 4 = 1 THEN 'one match only' ELSE 'not placed' END reason FROM customer")
def unregistered_reasons(spark, d):
    k = F.col("c_custkey")
    r = X.unregistered_reason(F.col("c_nationkey") % 5, k % 4, F.when(k % 3 == 0, 2).otherwise(1))
    return V.table(spark, d, "customer").select(k.alias("id"), r.alias("reason"))


@query("WITH p AS (SELECT p_partkey id, p_retailprice - 890 t FROM part) SELECT id, CASE WHEN t <= 0 THEN NULL ELSE pow(10, floor(log10(t))) * CASE WHEN t/pow(10, floor(log10(t))) <= 1 THEN 1 WHEN t/pow(10, floor(log10(t))) <= 2 THEN 2 WHEN t/pow(10, floor(log10(t))) <= 5 THEN 5 ELSE 10 END END nice, greatest(20.0, least(t, 60.0)) clamped FROM p")
def nice_spacing(spark, d):
    t = F.col("p_retailprice") - 890
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.nice_spacing(t).alias("nice"), S.clamp(t, 20.0, 60.0).alias("clamped"))


@query("SELECT p_partkey id, p_size || CASE WHEN p_size = 1 THEN ' point' ELSE ' points' END label, (p_size*61) // 60 || ':' || lpad(CAST((p_size*61) % 60 AS VARCHAR), 2, '0') || '.250' stamp, CASE WHEN p_size < 2 THEN p_size * 700 || ' B' ELSE format('{:.1f}', p_size*700/1024.0) || ' KB' END size FROM part")
def small_formats(spark, d):
    n = F.col("p_size")
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.pluralize(n, "point").alias("label"), text.frame_timestamp(n * 61 + 0.25).alias("stamp"), text.format_bytes(n * 700).alias("size"))


@query("WITH c AS (SELECT c_custkey AS code, c_name AS name FROM customer), r AS (SELECT code, name, CASE WHEN code = 12 THEN 0 WHEN starts_with(CAST(code AS VARCHAR), '12') THEN 1 WHEN contains(lower(name), '12') THEN 3 END rank FROM c) SELECT CAST(code AS BIGINT) code, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, code LIMIT 12")
def crs_search(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"))
    return text.crs_search(c, "12").select("code", F.col("rank").cast("int").alias("rank"))


_PAIR = f"{V.POINTS}, s AS (SELECT x sx, y sy, z sz, 1.5*(0.8*x-0.6*y)+7 tx, 1.5*(0.6*x+0.8*y)-3 ty, 1.5*z+2 tz FROM points)"


@query(f"WITH {_PAIR} SELECT count(*) n, round(avg(sx),6) msx, round(avg(tx),6) mtx, round(covar_pop(sx,tx),5) cxx, round(covar_pop(sx,ty),5) cxy, round(var_pop(sx)+var_pop(sy)+var_pop(sz),5) vs FROM s")
def similarity_sums(spark, d):
    p = V.points(spark, d)
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    s = p.select(x.alias("sx"), y.alias("sy"), z.alias("sz"), (1.5 * (0.8 * x - 0.6 * y) + 7).alias("tx"), (1.5 * (0.6 * x + 0.8 * y) - 3).alias("ty"), (1.5 * z + 2).alias("tz"))
    out = E.similarity_sums(s)
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("msx", "mtx")], *[F.round(c, 5).alias(c) for c in ("cxx", "cxy", "vs")])


_LL = "p AS (SELECT c_custkey id, (c_custkey*37 % 3599)/10.0-180 lon, (c_custkey*53 % 1600)/10.0-80 lat FROM customer)"


@query(f"WITH {_LL} SELECT id, round(2*6371008.8*asin(sqrt(least(1, sin(radians(47-lat)/2)**2 + cos(radians(lat))*cos(radians(47))*sin(radians(8-lon)/2)**2))),2) metres, round(radians(lon)*{geom.A},3) mx, round(ln(tan(pi()/4+radians(lat)/2))*{geom.A},3) my FROM p")
def map_distances(spark, d):
    k = F.col("c_custkey")
    lon, lat = (k * 37 % 3599) / 10.0 - 180, (k * 53 % 1600) / 10.0 - 80
    mx, my = geom.web_mercator(lon, lat)
    return V.table(spark, d, "customer").select(k.alias("id"), F.round(geom.haversine(lon, lat, F.lit(8.0), F.lit(47.0)), 2).alias("metres"), F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


@query("SELECT l_linenumber row, round(avg(1/(1 + 0.01*sqrt((l_partkey % 100 - 50)**2 + (l_quantity-25)**2) + 0.0001*((l_partkey % 100 - 50)**2 + (l_quantity-25)**2))),8) vignette FROM lineitem GROUP BY 1")
def vignette(spark, d):
    v = color.vignette(F.col("l_partkey") % 100, F.col("l_quantity"), 50, 25, [0.01, 0.0001])
    return V.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("row")).agg(F.round(F.avg(v), 8).alias("vignette"))


@query()
def cloth_ground(spark, d):
    """Ground classes of the cloud; held against a made scene in the tests."""
    return K.cloth_ground(V.points(spark, d), 4.0).groupBy("classification").agg(F.count(F.lit(1)).alias("n"))


@query()
def cloud_normals(spark, d):
    """Eigenvectors by batches; held against a known plane in the tests."""
    return K.normals(V.points(spark, d), 2.0, 6)


_SOLID = "r AS (SELECT *, floor(x/3.0) ca, floor(y/3.0) cb, floor(z/3.0) cc FROM points WHERE z >= 2), c AS (SELECT ca, cb, cc, count(*) n FROM r GROUP BY 1,2,3), m AS (SELECT p.ca, p.cb, p.cc, count(q.ca) m FROM c p LEFT JOIN c q ON q.ca BETWEEN p.ca-1 AND p.ca+1 AND q.cb BETWEEN p.cb-1 AND p.cb+1 AND q.cc BETWEEN p.cc-1 AND p.cc+1 AND NOT (q.ca=p.ca AND q.cb=p.cb AND q.cc=p.cc) WHERE p.n <= 2 GROUP BY 1,2,3), solid AS (SELECT r.pid, r.x, r.y, r.z FROM r JOIN c USING (ca, cb, cc) LEFT JOIN m USING (ca, cb, cc) WHERE c.n > 2 OR m.m >= 2)"


@query(f"WITH {V.POINTS}, {_SOLID}, {V.near_sql(2.0, 'solid', 'solid', ' AND a.pid <> b.pid')}, k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, qid) rn FROM near), o AS (SELECT pid, avg(sqrt(d2)) AS mean FROM k WHERE rn <= 12 GROUP BY 1) SELECT pid FROM o WHERE mean <= (SELECT avg(mean) + 1.5 * stddev_pop(mean) FROM o)")
def filter_chain(spark, d):
    steps = [("range", {"z_min": 2}), ("isolated", {"size": 3.0}), ("outlier", {"reach": 2.0})]
    return C.filter_chain(V.points(spark, d), steps).select("pid")


_PAIRS = V.EDGES + ", p AS (SELECT id_a, id_b, inliers, CASE WHEN (id_a+id_b) % 13 = 0 THEN 'error' ELSE 'done' END status, inliers < 10 weak, (id_a*id_b) % 7 <> 0 enabled, CASE WHEN (id_a+id_b) % 3 = 0 THEN inliers ELSE 0 END shared FROM edges)"


@query(f"WITH {_PAIRS} SELECT count(*) FILTER (status='done' AND inliers > 0) verified, count(*) FILTER (status='done' AND inliers > 0 AND weak) weak, count(*) FILTER (NOT enabled) excluded, count(*) FILTER (status='running') running, count(*) FILTER (status='error') \"error\", count(*) FILTER (status='done' AND inliers > 0 AND shared > 0) used, min(inliers) FILTER (status='done' AND inliers > 0 AND enabled AND NOT weak) least, quantile_cont(inliers, 0.5) FILTER (status='done' AND inliers > 0 AND enabled AND NOT weak) median, max(inliers) FILTER (status='done' AND inliers > 0 AND enabled AND NOT weak) most FROM p")
def pair_stats(spark, d):
    from terrafold.operators import survey

    a, b = F.col("id_a"), F.col("id_b")
    e = V.edges(spark, d)
    pairs = e.select(a, b, "inliers", F.when((a + b) % 13 == 0, "error").otherwise("done").alias("status"), (F.col("inliers") < 10).alias("weak"), ((a * b) % 7 != 0).alias("enabled"))
    return survey.pair_stats(pairs, e.where((a + b) % 3 == 0).select("id_a", "id_b", F.col("inliers").alias("shared")))


@query("WITH g AS (SELECT c_custkey name_, CASE c_custkey % 3 WHEN 0 THEN 'check' ELSE 'control' END role, c_custkey % 11 <> 0 enabled, CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END z FROM customer), m AS (SELECT o_custkey name_, count(DISTINCT o_orderkey % 9) marks FROM orders GROUP BY 1), j AS (SELECT *, coalesce(marks, 0) k, enabled AND role = 'control' AND z IS NOT NULL ok FROM g LEFT JOIN m USING (name_)) SELECT count(*) FILTER (ok AND k >= 2) ready, count(*) FILTER (ok AND k < 2) want_marks, count(*) FILTER (role = 'control' AND NOT ok) want_coordinates, count(*) FILTER (role = 'check') checks FROM j")
def control_readiness(spark, d):
    from terrafold.operators import survey

    k = F.col("c_custkey")
    gcps = V.table(spark, d, "customer").select(k.alias("name"), F.when(k % 3 == 0, "check").otherwise("control").alias("role"), (k % 11 != 0).alias("enabled"), F.lit(1.0).alias("x"), F.lit(2.0).alias("y"), F.when(k % 17 != 0, F.col("c_acctbal")).alias("z"))
    marks = V.table(spark, d, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_orderkey") % 9).alias("image_id"))
    return survey.control_readiness(gcps, marks)


_RING_SQL = "r AS (SELECT o_custkey id, list(struct_pack(x := (o_orderkey % 97)::DOUBLE, y := (o_orderkey % 89)::DOUBLE) ORDER BY o_orderkey) p FROM orders GROUP BY 1)"


@query(f"WITH {_RING_SQL}, k AS (SELECT id, p, unnest(range(len(p))) k FROM r), s AS (SELECT id, any_value(len(p)) n, sum(CASE WHEN k > 0 THEN sqrt((p[k+1].x-p[k].x)**2+(p[k+1].y-p[k].y)**2) ELSE 0 END) length, sum((p[k+1].x-p[1].x)*(p[(k+1)%len(p)+1].y-p[1].y)-(p[(k+1)%len(p)+1].x-p[1].x)*(p[k+1].y-p[1].y)) twice FROM k GROUP BY 1) SELECT id, round(CASE WHEN n < 2 THEN 0 ELSE length END,6) length, round(CASE WHEN n < 3 THEN 0 ELSE abs(twice)/2 END,6) area FROM s")
def ring_measures(spark, d):
    from terrafold.operators import survey

    k = F.col("o_orderkey")
    rows = V.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.struct(k.alias("k"), (k % 97).cast("double").alias("x"), (k % 89).cast("double").alias("y")).alias("v"))
    rings = rows.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("v")), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("p"))
    return rings.select("id", F.round(survey.polyline("p"), 6).alias("length"), F.round(survey.shoelace("p"), 6).alias("area"))


@query("WITH t AS (SELECT DISTINCT l_suppkey image_id, l_partkey kp, l_partkey % 700 pt FROM lineitem), u AS (SELECT image_id, kp, min(pt) pt FROM t GROUP BY 1,2), m AS (SELECT l_suppkey id_a, l_suppkey % 40 + 1 id_b, l_partkey kp_a, l_orderkey % 2000 kp_b, l_quantity / 10.0 AS err FROM lineitem), j AS (SELECT m.*, a.pt pa, b.pt pb FROM m LEFT JOIN u a ON a.image_id = id_a AND a.kp = kp_a LEFT JOIN u b ON b.image_id = id_b AND b.kp = kp_b), s AS (SELECT id_a, id_b, count(*) n, count(*) FILTER (pa = pb) together, count(*) FILTER (pa <> pb) split, count(*) FILTER (pa = pb OR ((pa IS NULL OR pb IS NULL) AND err <= 4)) fits FROM j GROUP BY 1,2) SELECT id_a, id_b, n, together, split, CASE WHEN n < 8 THEN 'unknown' WHEN fits >= 0.5*n THEN 'agrees' ELSE 'conflicts' END verdict FROM s")
def pair_agreement(spark, d):
    from terrafold.operators import survey

    li = V.table(spark, d, "lineitem")
    tracks = li.groupBy(F.col("l_suppkey").alias("image_id"), F.col("l_partkey").alias("kp")).agg(F.min(F.col("l_partkey") % 700).alias("pt"))
    matches = li.select(F.col("l_suppkey").alias("id_a"), (F.col("l_suppkey") % 40 + 1).alias("id_b"), F.col("l_partkey").alias("kp_a"), (F.col("l_orderkey") % 2000).alias("kp_b"), (F.col("l_quantity") / 10.0).alias("error"))
    return survey.pair_agreement(matches, tracks)


@query()
def core_extent(spark, d):
    """Two rounds of histograms; held against a made scene in the tests."""
    from terrafold.operators import survey

    e = survey.core_extent(V.points(spark, d))
    return spark.createDataFrame([tuple(round(e[k], 6) for k in sorted(e))], ", ".join(f"{k} double" for k in sorted(e)))


@query()
def dem_enclosed_fill(spark, d):
    """Pull and push over a pyramid; which cells are filled is checked by enclosed_gaps."""
    from terrafold.operators import survey

    r, c = F.col("row"), F.col("col")
    dense = V.cells(spark, d).where(((r * 7 + c * 3) % 5 != 0) & ~(r.between(8, 11) & c.between(8, 14)) & ~((r < 3) & (c > 20)))
    return survey.fill_enclosed(dense).withColumn("z", F.round("z", 6))


@query(f"WITH {V.OBSERVATIONS}, t AS (SELECT pt, count(*) \"views\" FROM observations GROUP BY 1), p AS (SELECT (pt*37 % 997)/10.0 x, (pt*53 % 613)/10.0 y, \"views\" FROM t), b AS (SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1, greatest(max(x)-min(x), max(y)-min(y))/20 s FROM p) SELECT CAST(least(floor((x-x0)/s), ceil((x1-x0)/s)-1) AS BIGINT) cx, CAST(least(floor((y-y0)/s), ceil((y1-y0)/s)-1) AS BIGINT) cy, count(*) points, max(\"views\") \"views\" FROM p, b GROUP BY 1, 2")
def coverage_grid(spark, d):
    from terrafold.operators import rules

    t = V.observations(spark, d).groupBy("pt").agg(F.count(F.lit(1)).alias("views"))
    return rules.coverage(t.select((F.col("pt") * 37 % 997 / 10.0).alias("x"), (F.col("pt") * 53 % 613 / 10.0).alias("y"), "views"), 20)


@query(f"WITH {V.POINTS} SELECT round(quantile_cont(z, 0.02),6) low, round(quantile_cont(z, 0.98),6) high FROM points")
def display_range(spark, d):
    from terrafold.operators import rules

    return rules.display_range(V.points(spark, d), "z").select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("WITH o AS (SELECT l_suppkey i, (l_extendedprice + 1000) / 1200.0 g FROM lineitem), c AS (SELECT i, list_sort(list(g))[count(*)//2+1] m FROM o GROUP BY 1) SELECT list_sort(list(m))[count(*)//2+1] gsd FROM c")
def photo_gsd(spark, d):
    from terrafold.operators import rules

    o = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("image_id"), (F.col("l_extendedprice") + 1000).alias("distance"), F.lit(1200.0).alias("fx"))
    return rules.photo_gsd(o)


@query("SELECT vec_id id, round(list_sum(list_transform(embedding, lambda x: sqrt(abs(CAST(x AS DOUBLE))))) / sqrt(list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))))), 5) total FROM embeddings")
def root_sift(spark, d):
    from terrafold.operators import rules

    v = V.descriptors(spark, d).select("id", rules.root_sift("v").alias("r"))
    return v.select("id", F.round(F.aggregate("r", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query(f"WITH {V.POINTS}, c AS (SELECT floor(y/8) row, floor(x/8) col, pid % 3 tile, CASE pid % 3 WHEN 0 THEN 2.0 WHEN 1 THEN 1.0 ELSE 2.0 END gsd, max(z) z FROM points GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY gsd, tile) k FROM c) SELECT CAST(row AS BIGINT) row, CAST(col AS BIGINT) col, z FROM r WHERE k = 1")
def mosaic_grid(spark, d):
    from terrafold.operators import rules

    p, tile = V.points(spark, d), F.col("pid") % 3
    c = p.groupBy(F.floor(F.col("y") / 8).alias("row"), F.floor(F.col("x") / 8).alias("col"), tile.alias("tile"), F.when(tile == 1, 1.0).otherwise(2.0).alias("gsd")).agg(F.max("z").alias("z"))
    return rules.mosaic(c)


@query("WITH l AS (SELECT doc_id image_id, n_chars score, regexp_extract(text, 'version ([0-9])', 1) v FROM (SELECT doc_id, n_chars, lower(text) AS text FROM documents)) SELECT v \"value\", count(*) photos, CAST(sum(score) AS BIGINT) weight FROM l WHERE v <> '' GROUP BY 1")
def text_votes(spark, d):
    from terrafold.operators import rules

    lines = V.table(spark, d, "documents").select(F.col("doc_id").alias("image_id"), F.lower("text").alias("text"), F.col("n_chars").alias("score"))
    return rules.votes(lines, "version ([0-9])")


@query("SELECT p_partkey id, round(p_size * CASE p_size % 4 WHEN 0 THEN 0.01 WHEN 1 THEN 0.3048 WHEN 2 THEN 1000 END, 8) metres, round(1.0/(p_size*p_size/100.0),8) weight, round(CASE WHEN p_size % 5 = 0 THEN p_retailprice WHEN p_size % 5 = 1 THEN 8.8/0.0024 ELSE p_size/36.0*4000 END,6) focal, round(CASE WHEN p_size/20.0 <= 1 THEN p_size*p_size/800.0 ELSE p_size/20.0 - 0.5 END,8) huber FROM part")
def small_rules(spark, d):
    from terrafold.operators import rules

    n = F.col("p_size")
    unit = F.when(n % 4 == 0, "cm").when(n % 4 == 1, "ft").when(n % 4 == 2, "KM").otherwise("cubit")
    focal = rules.focal_px(F.when(n % 5 == 0, F.col("p_retailprice")), F.lit(8.8), F.when(n % 5 == 1, 0.0024), n.cast("double"), F.lit(4000.0))
    return V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(rules.to_metres(n, unit), 8).alias("metres"), F.round(rules.weight_of(n / 10.0), 8).alias("weight"), F.round(focal, 6).alias("focal"), F.round(rules.robust_cost(n.cast("double"), "huber", 20.0), 8).alias("huber"))


@query("WITH i AS (SELECT o_custkey seq, o_orderkey id FROM orders) SELECT seq, id, lag(id) OVER w \"before\", lead(id) OVER w \"after\" FROM i WINDOW w AS (PARTITION BY seq ORDER BY id)")
def image_order(spark, d):
    from terrafold.operators import rules

    o = V.table(spark, d, "orders").select(F.col("o_custkey").alias("seq"), F.col("o_orderkey").alias("id"))
    return rules.neighbours_in_order(o, "seq", "id", "id")


@query(f"WITH {V.POINTS}, s AS (SELECT unnest([quantile_cont(x,0.02), quantile_cont(y,0.02), quantile_cont(z,0.02)]) a, unnest([quantile_cont(x,0.98), quantile_cont(y,0.98), quantile_cont(z,0.98)]) b, unnest(['x','y','z']) c FROM points) SELECT c, round(a-(b-a)*0.05,6) low, round(b+(b-a)*0.05,6) high FROM s")
def robust_box(spark, d):
    from terrafold.operators import rules

    b = rules.robust_box(V.points(spark, d))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.round(f"{c}_min", 6).alias("low"), F.round(f"{c}_max", 6).alias("high")) for c in "xyz"]))
    return b.select(rows.alias("r")).select("r.*")


@query(f"WITH {V.EDGES}, t AS (SELECT id_a, id_b, CASE WHEN inliers % 3 = 0 THEN 'done' ELSE 'rejected' END status, inliers*2 raw, (id_a+id_b) % 19 = 0 excluded FROM edges), p AS (SELECT s_suppkey id, CASE WHEN s_suppkey % 10 < 8 THEN 0 ELSE s_suppkey % 10 - 7 END piece FROM supplier), x AS (SELECT greatest(a.piece,b.piece) piece, t.*, CASE WHEN raw >= 8 THEN 0 ELSE 2 END kind FROM t JOIN p a ON a.id=id_a JOIN p b ON b.id=id_b WHERE a.piece <> b.piece AND least(a.piece,b.piece) = 0 AND status = 'rejected' AND NOT excluded), r AS (SELECT *, row_number() OVER (PARTITION BY piece ORDER BY kind, raw DESC, id_a, id_b) rank FROM x) SELECT piece, id_a, id_b, kind, rank FROM r WHERE rank <= 15")
def gap_plan(spark, d):
    from terrafold.operators import rules

    e, k = V.edges(spark, d), F.col("s_suppkey")
    tried = e.select("id_a", "id_b", F.when(F.col("inliers") % 3 == 0, "done").otherwise("rejected").alias("status"), (F.col("inliers") * 2).alias("raw"), ((F.col("id_a") + F.col("id_b")) % 19 == 0).alias("excluded"))
    pieces = V.table(spark, d, "supplier").select(k.alias("id"), F.when(k % 10 < 8, 0).otherwise(k % 10 - 7).cast("bigint").alias("piece"))
    none = e.select("id_a", "id_b", F.lit(0.5).alias("share")).where("false")
    return rules.gap_plan(pieces, tried, none, 15, 200, 8)


_TRACKS = "m AS (SELECT a.l_suppkey*4294967296 + a.l_orderkey*8+a.l_linenumber a, b.l_suppkey*4294967296 + b.l_orderkey*8+b.l_linenumber b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1), e AS (SELECT a, b FROM m UNION SELECT b, a FROM m), r AS (SELECT DISTINCT a n, a x FROM e UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.x), c AS (SELECT n, min(x) pt FROM r GROUP BY 1), s AS (SELECT pt, n // 4294967296 i, min(n % 4294967296) kp FROM c GROUP BY 1, 2 HAVING count(*) = 1)"


@query(f"WITH RECURSIVE {_TRACKS} SELECT pt, i image_id, kp FROM s WHERE pt IN (SELECT pt FROM s GROUP BY 1 HAVING count(*) >= 2)")
def build_tracks(spark, d):
    """Consecutive lines of an order match; suppliers are the photographs."""
    from terrafold.operators import graph

    li = V.table(spark, d, "lineitem")
    lines = lambda c, shift: li.select("l_orderkey", (F.col("l_linenumber") - shift).alias("step"), F.col("l_suppkey").alias(f"id_{c}"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(f"kp_{c}"))
    return graph.build_tracks(lines("a", 0).join(lines("b", 1), ["l_orderkey", "step"]).select("id_a", "kp_a", "id_b", "kp_b"))


@query("SELECT l_orderkey*8+l_linenumber id, min(CASE WHEN hag < 0.3 THEN 2 WHEN hag >= 2 AND p <= 0.02 AND g < 0.05 THEN 6 WHEN g >= 0.05 OR p > 0.02 THEN CASE WHEN hag < 0.5 THEN 3 WHEN hag < 2 THEN 4 ELSE 5 END ELSE 1 END) classification FROM (SELECT *, l_quantity/10.0 hag, l_tax+0.0 p, l_discount-0.03 g FROM lineitem) GROUP BY 1")
def above_ground(spark, d):
    from terrafold.operators import rules

    li = V.table(spark, d, "lineitem")
    p = li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_quantity") / 10.0).alias("hag"), (F.col("l_tax") + 0.0).alias("planarity"), (F.col("l_discount") - 0.03).alias("exg"))
    return rules.above_ground(p).groupBy("id").agg(F.min("classification").alias("classification"))
