"""Cloud and raster queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.operators import cloud as C
from terrafold.operators import raster as R
from terrafold.plans import views as V
from terrafold.plans.register import Catalog

catalog = Catalog()
query = catalog.query


def r6(*names: str):
    return {n: F.round(F.col(n), 6) for n in names}


@query(f"WITH {V.POINTS} SELECT CAST(floor(x/4) AS BIGINT) ix, CAST(floor(y/4) AS BIGINT) iy, CAST(floor(z/4) AS BIGINT) iz, count(*) n, round(avg(x),6) x, round(avg(y),6) y, round(avg(z),6) z, CAST(floor(avg(r)+0.5) AS BIGINT) r, CAST(floor(avg(g)+0.5) AS BIGINT) g, CAST(floor(avg(b)+0.5) AS BIGINT) b FROM points GROUP BY 1,2,3")
def voxel_mean(spark, d):
    return C.voxel_mean(V.points(spark, d), 4.0).withColumns(r6("x", "y", "z"))


@query(f"WITH {V.POINTS} SELECT min(pid) pid, CAST(floor(x/8) AS BIGINT) ix, CAST(floor(y/8) AS BIGINT) iy, CAST(floor(z/8) AS BIGINT) iz FROM points GROUP BY 2,3,4")
def voxel_first(spark, d):
    return C.voxel_first(V.points(spark, d), 8.0).select("pid", "ix", "iy", "iz")


@query(f"WITH {V.POINTS} SELECT count(*) n, sum(pid)::BIGINT s FROM points WHERE x >= 10 AND x <= 40 AND y >= 5 AND z <= 30")
def crop_box(spark, d):
    return C.crop_box(V.points(spark, d), {"x": 10, "y": 5}, {"x": 40, "z": 30}).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("s"))


@query(f"WITH {V.POINTS} SELECT count(*) n, sum(pid)::BIGINT s FROM points WHERE NOT (x >= 10 AND x <= 40)")
def crop_box_inverted(spark, d):
    return C.crop_box(V.points(spark, d), {"x": 10}, {"x": 40}, invert=True).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("s"))


@query(f"WITH {V.POINTS} SELECT count(*) n, sum(pid)::BIGINT s FROM points WHERE z >= 5 AND z <= 45 AND r*0.2126+g*0.7152+b*0.0722 >= 60.001 AND r*0.2126+g*0.7152+b*0.0722 <= 180.001")
def range_luma(spark, d):
    return C.filter_range(V.points(spark, d), 5, 45, 60.001, 180.001).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("s"))


@query(f"WITH {V.POINTS}, c AS (SELECT floor(x/1.5) a, floor(y/1.5) b, floor(z/1.5) c, count(*) n FROM points GROUP BY 1,2,3), m AS (SELECT p.a,p.b,p.c, count(q.a) m FROM c p LEFT JOIN c q ON q.a BETWEEN p.a-1 AND p.a+1 AND q.b BETWEEN p.b-1 AND p.b+1 AND q.c BETWEEN p.c-1 AND p.c+1 AND NOT (q.a=p.a AND q.b=p.b AND q.c=p.c) WHERE p.n <= 2 GROUP BY 1,2,3) SELECT p.pid FROM points p JOIN c ON floor(x/1.5)=c.a AND floor(y/1.5)=c.b AND floor(z/1.5)=c.c LEFT JOIN m ON m.a=c.a AND m.b=c.b AND m.c=c.c WHERE c.n > 2 OR m.m >= 7")
def isolated_cells(spark, d):
    return C.remove_isolated(V.points(spark, d), 1.5, min_neighbours=7).select("pid")


_OTHERS = V.near_sql(2.0, extra=" AND a.pid <> b.pid")


@query(f"WITH {V.POINTS}, {_OTHERS}, k AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY d2, qid) rn FROM near), m AS (SELECT pid, avg(sqrt(d2)) AS mean FROM k WHERE rn <= 12 GROUP BY 1) SELECT pid FROM m WHERE mean <= (SELECT avg(mean) + 1.5 * stddev_pop(mean) FROM m)")
def outlier_filter(spark, d):
    return C.outlier_filter(V.points(spark, d), 2.0).select("pid")


@query(f"WITH {V.POINTS}, {_OTHERS} SELECT pid, count(*) n, round(min(d2),6) nearest FROM near GROUP BY 1")
def radius_neighbours(spark, d):
    return C.neighbour_counts(V.points(spark, d), 2.0).withColumns(r6("nearest"))


@query(f"WITH {V.POINTS}, a AS (SELECT * FROM points WHERE pid // 64 % 2 = 0), b AS (SELECT * FROM points WHERE pid // 64 % 2 = 1), {V.near_sql(2.0, 'a', 'b')}, m AS (SELECT pid, min(d2) d2 FROM near GROUP BY 1) SELECT a.pid, round(sqrt(m.d2),6) distance FROM a LEFT JOIN m USING (pid)")
def cloud_distance(spark, d):
    """The two epochs are the even and the odd orders: every point belongs to one."""
    p = V.points(spark, d)
    epoch = F.floor(F.col("pid") / 64) % 2
    return C.cloud_distance(p.where(epoch == 0), p.where(epoch == 1), 2.0).select("pid", F.round("distance", 6).alias("distance"))


@query(f"WITH {V.POINTS}, e AS (SELECT *, pid // 64 % 2 AS src, floor(x/4) ia, floor(y/4) ib, floor(z/4) ic FROM points), o AS (SELECT ia,ib,ic,min(src) owner FROM e GROUP BY 1,2,3) SELECT src, count(*) n, sum(pid)::BIGINT s FROM e JOIN o USING (ia,ib,ic) WHERE src = owner GROUP BY 1")
def merge_clouds(spark, d):
    p = V.points(spark, d)
    even = F.floor(F.col("pid") / 64) % 2
    return C.merge_clouds([p.where(even == 0), p.where(even == 1)], 4.0).groupBy(F.col("src").cast("bigint").alias("src")).agg(F.count(F.lit(1)).alias("n"), F.sum("pid").alias("s"))


@query(f"WITH {V.POINTS}, s AS (SELECT pid, (x-10)*0.6+(y-10)*0.8 station, (y-10)*0.6-(x-10)*0.8 AS o FROM points) SELECT pid, round(station,6) station, round(o,6) \"offset\" FROM s WHERE abs(o) <= 1.005 AND station >= 0 AND station <= 50")
def section(spark, d):
    return C.section(V.points(spark, d), (10, 10), (40, 50), 2.01).select("pid", F.round("station", 6).alias("station"), F.round("offset", 6).alias("offset"))


@query(f"WITH {V.POINTS} SELECT count(*) n, min(x) x_min, max(x) x_max, min(y) y_min, max(y) y_max, min(z) z_min, max(z) z_max FROM points")
def cloud_bounds(spark, d):
    return C.bounds(V.points(spark, d))


@query(f"WITH {V.POINTS}, b AS (SELECT count(*) n, max(x)-min(x) a, max(y)-min(y) b, max(z)-min(z) c FROM points) SELECT n, round(pow(a*b*c/n, 1.0/3), 6) by_volume, round(sqrt(a*b/n),6) by_area FROM b")
def cloud_spacing(spark, d):
    return C.spacing(V.points(spark, d)).withColumns(r6("by_volume", "by_area"))


@query(f"WITH {V.POINTS}, p AS (SELECT pid, CAST(least(31,greatest(0,floor(x/3.3))) AS BIGINT) ix, CAST(least(31,greatest(0,floor(y/3.3))) AS BIGINT) iy, CAST(least(31,greatest(0,floor(z/3.3))) AS BIGINT) iz, x, y, z FROM points), q AS (SELECT *, row_number() OVER (PARTITION BY ix,iy,iz ORDER BY round((x/3.3-ix-0.5)**2+(y/3.3-iy-0.5)**2+(z/3.3-iz-0.5)**2, 9), pid) rn FROM p) SELECT ix, iy, iz, count(*) n FROM q WHERE rn = 1 GROUP BY 1,2,3")
def octree_pick(spark, d):
    return C.octree_pick(V.points(spark, d), (0, 0, 0), 3.3 * 32, 32).select("ix", "iy", "iz", F.lit(1).cast("bigint").alias("n"))


@query(f"WITH {V.POINTS} SELECT classification, count(*) n FROM points GROUP BY 1")
def class_counts(spark, d):
    return C.class_counts(V.points(spark, d))


@query(f"WITH {V.POINTS} SELECT round(avg(0.8*x-0.6*y+10),6) x, round(avg(0.6*x+0.8*y-5),6) y, round(avg(2*z+1),6) z FROM points")
def transform_cloud(spark, d):
    m = [[0.8, -0.6, 0, 10], [0.6, 0.8, 0, -5], [0, 0, 2, 1], [0, 0, 0, 1]]
    return C.transform(V.points(spark, d), m).agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"])


@query(f"WITH {V.POINTS}, {V.near_sql(2.0)} SELECT pid, count(*) n, round(covar_pop(x,x)+3.14e-8,6) cxx, round(covar_pop(x,y)+3.14e-8,6) cxy, round(covar_pop(x,z)+3.14e-8,6) cxz, round(covar_pop(y,y)+3.14e-8,6) cyy, round(covar_pop(y,z)+3.14e-8,6) cyz, round(covar_pop(z,z)+3.14e-8,6) czz FROM near GROUP BY 1")
def covariance_normals(spark, d):
    # Coordinates in tenths give exact ties; the shift takes them off the rounding edge.
    return C.covariance_normals(V.points(spark, d), 2.0, 3.14e-8, 6)


_DEM = "SELECT CAST(CASE WHEN y = 0 THEN 51 ELSE floor((104.0-y)/2.0) END AS BIGINT) \"row\", CAST(CASE WHEN x = 104 THEN 51 ELSE floor(x/2.0) END AS BIGINT) col, {0} z, count(*) support FROM points WHERE x >= 0 AND x <= 104 AND y >= 0 AND y <= 104 GROUP BY 1, 2"


def _dem(how, sql):
    @catalog.named(f"dem_{how}", f"WITH {V.POINTS} " + _DEM.format(sql))
    def run(spark, d):
        return R.rasterize(V.points(spark, d), 2.0, 0.0, 104.0, 52, 52, how).withColumns(r6("z"))


for _how, _sql in (("max", "max(z)"), ("min", "min(z)"), ("mean", "round(avg(z),6)"), ("median", "list_sort(list(z))[count(*)//2+1]")):
    _dem(_how, _sql)

_OFFSETS = "o AS (SELECT a dr, b dc FROM range(-2,3) t(a), range(-2,3) s(b) WHERE a*a+b*b BETWEEN 1 AND 4)"
_HOLES = "box AS (SELECT r row, c col FROM (SELECT unnest(range((SELECT min(row) FROM holed), (SELECT max(row) FROM holed)+1)) r), (SELECT unnest(range((SELECT min(col) FROM holed), (SELECT max(col) FROM holed)+1)) c)), holes AS (SELECT * FROM box ANTI JOIN holed USING (row, col))"
_FILL = f"WITH {V.HOLED}, {_OFFSETS}, {_HOLES}, near AS (SELECT h.row, h.col, o.dr, o.dc, z, o.dr*o.dr+o.dc*o.dc AS d2 FROM holes h, o JOIN holed ON holed.row = h.row + o.dr AND holed.col = h.col + o.dc) "


@query(_FILL + "SELECT row, col, round(z,6) z, 0 filled FROM holed UNION ALL SELECT row, col, round(sum(z/d2)/sum(1.0/d2),6), 1 FROM near GROUP BY 1, 2")
def dem_idw_fill(spark, d):
    return R.fill_nodata(V.holed(spark, d)).withColumns(r6("z"))


@query(_FILL + "SELECT row, col, round(z,6) z, 0 filled FROM holed UNION ALL SELECT row, col, round(z,6), 1 FROM (SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY d2, dr, dc) rn FROM near) WHERE rn = 1")
def dem_nearest_fill(spark, d):
    return R.fill_nodata(V.holed(spark, d), method="nearest").withColumns(r6("z"))


_N = lambda r, c: f"coalesce((SELECT z FROM holed n WHERE n.row = h.row + {r} AND n.col = h.col + {c}), h.z)"


@query(f"WITH {V.HOLED}, n AS (SELECT row, col, z, (({_N(-1, 1)}+2*{_N(0, 1)}+{_N(1, 1)})-({_N(-1, -1)}+2*{_N(0, -1)}+{_N(1, -1)}))/32 AS p, (({_N(-1, -1)}+2*{_N(-1, 0)}+{_N(-1, 1)})-({_N(1, -1)}+2*{_N(1, 0)}+{_N(1, 1)}))/32 AS q FROM holed h) SELECT row, col, round(degrees(atan(sqrt(p*p+q*q))),5) slope, round(100*sqrt(p*p+q*q),4) slope_percent, round(CASE WHEN p = 0 AND q = 0 THEN -1 WHEN atan2(-p,-q) < 0 THEN degrees(atan2(-p,-q)) + 360 ELSE degrees(atan2(-p,-q)) END,4) aspect, CAST(greatest(1, floor(1.5 + 254*greatest(0, (sin(radians(45)) - (p*sin(radians(315))+q*cos(radians(315)))*cos(radians(45)))/sqrt(1+p*p+q*q)))) AS BIGINT) shade FROM n")
def terrain_horn(spark, d):
    out = R.horn(V.holed(spark, d), 4.0)
    return out.select("row", "col", F.round("slope", 5).alias("slope"), F.round("slope_percent", 4).alias("slope_percent"), F.round("aspect", 4).alias("aspect"), "shade")


_V = lambda r, c: f"(SELECT z FROM holed n WHERE n.row = CAST(floor(fr) AS BIGINT) + {r} AND n.col = CAST(floor(fc) AS BIGINT) + {c})"


@query(f"WITH {V.HOLED}, p AS (SELECT c_custkey id, 2 + (c_custkey*37 % 990)/10.0 x, 6 + (c_custkey*53 % 950)/10.0 y FROM customer), f AS (SELECT id, x/4-0.5 fc, (104.0-y)/4-0.5 fr FROM p), v AS (SELECT id, fc-floor(fc) tx, fr-floor(fr) ty, {_V(0, 0)} v00, {_V(0, 1)} v01, {_V(1, 0)} v10, {_V(1, 1)} v11 FROM f) SELECT id, round(coalesce((v00*(1-tx)+v01*tx)*(1-ty)+(v10*(1-tx)+v11*tx)*ty, CASE WHEN ty >= 0.5 THEN CASE WHEN tx >= 0.5 THEN v11 ELSE v10 END ELSE CASE WHEN tx >= 0.5 THEN v01 ELSE v00 END END, v00, v01, v10, v11),6) z FROM v")
def sample_bilinear(spark, d):
    k = F.col("c_custkey")
    places = V.table(spark, d, "customer").select(k.alias("id"), (2 + (k * 37 % 990) / 10.0).alias("x"), (6 + (k * 53 % 950) / 10.0).alias("y"))
    return R.sample(V.holed(spark, d), places, 4.0, 0.0, 104.0).withColumns(r6("z"))


@query(f"WITH {V.CELLS}, a AS (SELECT row//2 row, col//2 col, avg(z) z FROM cells GROUP BY 1,2), b AS (SELECT row//2 row, col//2 col, avg(z) z FROM a GROUP BY 1,2) SELECT 0 level, row, col, round(z,6) \"value\" FROM cells UNION ALL SELECT 1, row, col, round(z,6) FROM a UNION ALL SELECT 2, row, col, round(z,6) FROM b")
def raster_overviews(spark, d):
    return R.overview(V.cells(spark, d), 2).withColumns(r6("value"))


@query(f"WITH {V.HOLED} SELECT row//4 row, col//4 col, CAST(floor(count(*)*255.0/16+0.5) AS BIGINT) support FROM holed GROUP BY 1,2")
def support_overview(spark, d):
    return R.support_overview(V.holed(spark, d), 4)


_RING = [(12.3, 10.1), (80.7, 22.9), (70.1, 90.3), (40.2, 50.6), (15.4, 88.8)]


def _crossing(x: str, y: str) -> str:
    parts = []
    for (x1, y1), (x2, y2) in zip(_RING, _RING[1:] + _RING[:1], strict=True):
        parts.append(f"CASE WHEN {y} >= {min(y1, y2)} AND {y} < {max(y1, y2)} AND {x} < ({y} - {y1}) * {(x2 - x1) / (y2 - y1)!r} + {x1} THEN 1 ELSE 0 END")
    return "(" + " + ".join(parts) + ") % 2 = 1"


_CX, _CY = "(0.0 + (col + 0.5) * 4.0)", "(104.0 - (row + 0.5) * 4.0)"


@query(f"WITH {V.CELLS} SELECT row, col FROM cells WHERE {_crossing(_CX, _CY)}")
def polygon_mask(spark, d):
    x, y = R.centre(4.0, 0.0, 104.0)
    return V.cells(spark, d).where(R.inside_polygon(x, y, [_RING])).select("row", "col")


@query(f"WITH {V.CELLS} SELECT round(sum(greatest(z-25.0,0))*16,4) cut, round(sum(greatest(25.0-z,0))*16,4) fill, round(sum(z-25.0)*16,4) net, count(z) measured FROM cells WHERE {_crossing(_CX, _CY)}")
def polygon_volume(spark, d):
    out = R.volume(V.cells(spark, d), 4.0, 0.0, 104.0, [_RING], 25.0)
    return out.select(*[F.round(c, 4).alias(c) for c in ("cut", "fill", "net")], "measured")


@query(f"WITH {V.CELLS}, c AS (SELECT a.row, a.col, a.z v00, b.z v01, c.z v10, e.z v11 FROM cells a JOIN cells b ON b.row=a.row AND b.col=a.col+1 JOIN cells c ON c.row=a.row+1 AND c.col=a.col JOIN cells e ON e.row=a.row+1 AND e.col=a.col+1), l AS (SELECT *, unnest(range(CAST(floor(least(v00,v01,v10,v11)/2.5) AS BIGINT)+1, CAST(floor(greatest(v00,v01,v10,v11)/2.5) AS BIGINT)+1)) k FROM c) SELECT row, col, k*2.5 \"level\", CASE WHEN v00>=k*2.5 THEN 1 ELSE 0 END + CASE WHEN v01>=k*2.5 THEN 2 ELSE 0 END + CASE WHEN v11>=k*2.5 THEN 4 ELSE 0 END + CASE WHEN v10>=k*2.5 THEN 8 ELSE 0 END mask FROM l")
def contour_crossings(spark, d):
    return R.contour_crossings(V.cells(spark, d), 2.5)


@query(f"WITH {V.HOLED}, n AS (SELECT a.row, a.col, a.z, b.z v FROM holed a JOIN holed b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND NOT (a.row=b.row AND a.col=b.col)), j AS (SELECT row, col, count(*) n, quantile_cont(v, 0.5) m, count(*) FILTER (v < z + 0.5) low FROM n GROUP BY 1,2) SELECT h.row, h.col, round(CASE WHEN n >= 5 AND low <= 1 AND m - z > 0.5 THEN m ELSE z END,6) z FROM holed h LEFT JOIN j USING (row, col)")
def despike(spark, d):
    return R.despike(V.holed(spark, d), 0.5).withColumns(r6("z"))


@query(f"WITH {V.HOLED} SELECT a.row, a.col, round(sum(b.z*exp(-((a.row-b.row)**2+(a.col-b.col)**2)/2.0))/sum(exp(-((a.row-b.row)**2+(a.col-b.col)**2)/2.0)),6) z FROM holed a JOIN holed b ON b.row BETWEEN a.row-3 AND a.row+3 AND b.col BETWEEN a.col-3 AND a.col+3 GROUP BY 1,2")
def smooth_heights(spark, d):
    return R.smooth(V.holed(spark, d), 1.0).withColumns(r6("z"))


@query(f"WITH {V.POINTS} SELECT CAST(least(63,greatest(0,floor(x/1.640625))) AS BIGINT) bx, CAST(least(63,greatest(0,floor(y/1.640625))) AS BIGINT) \"by\", count(*) n FROM points GROUP BY 1,2")
def core_histogram(spark, d):
    return R.core_histogram(V.points(spark, d), 64, (0.0, 0.0), (105.0, 105.0))


_PLACE = "SELECT *, x/4-0.5 fc, (104.0-y)/4-0.5 fr FROM p"
_BETWEEN = f"SELECT id, distance, x, y, fc-floor(fc) tx, fr-floor(fr) ty, {_V(0, 0)} v00, {_V(0, 1)} v01, {_V(1, 0)} v10, {_V(1, 1)} v11 FROM f".replace("holed", "cells")
_HEIGHT = "coalesce((v00*(1-tx)+v01*tx)*(1-ty)+(v10*(1-tx)+v11*tx)*ty, CASE WHEN ty >= 0.5 THEN CASE WHEN tx >= 0.5 THEN v11 ELSE v10 END ELSE CASE WHEN tx >= 0.5 THEN v01 ELSE v00 END END, v00, v01, v10, v11)"
_HELD = "(floor((104.0-y)/4), floor(x/4)) IN (SELECT (CAST(row AS DOUBLE), CAST(col AS DOUBLE)) FROM cells)"


@query(f"WITH {V.CELLS}, p AS (SELECT id, id*80.0/54 AS distance, 10 + 64.0*id/54 x, 20 + 48.0*id/54 y FROM range(0,55) t(id)), f AS ({_PLACE}), v AS ({_BETWEEN}) SELECT id, round(distance,6) distance, CASE WHEN {_HELD} THEN round({_HEIGHT},6) END z FROM v")
def line_profile(spark, d):
    out = R.profile(V.cells(spark, d), [(10, 20), (74, 68)], 1.5, 4.0, 0.0, 104.0)
    return out.withColumns(r6("z", "distance"))


@query(f"WITH {V.CELLS}, p AS (SELECT id, id*200.0/4094 AS distance, CASE WHEN id <= 2047 THEN 2 + 100.0*id/2047 ELSE 102 END x, CASE WHEN id <= 2047 THEN 2 ELSE 2 + 100.0*(id-2047)/2047 END y FROM range(0,4095) t(id)), f AS ({_PLACE}), v AS ({_BETWEEN}) SELECT id, round(distance,6) distance, CASE WHEN {_HELD} THEN round({_HEIGHT},6) END z FROM v")
def long_profile(spark, d):
    """A polyline of over 4,096 steps: the spacing widens, and the whole line is covered."""
    out = R.profile(V.cells(spark, d), [(2, 2), (102, 2), (102, 102)], 0.01, 4.0, 0.0, 104.0)
    return out.withColumns(r6("z", "distance"))


@query()
def octree_levels(spark, d):
    """A level and node for every point; checked by its own rules in the tests."""
    return C.octree_levels(V.points(spark, d).select("pid", "x", "y", "z"), (0.0, 0.0, 0.0), 106.0, 16, 200)
