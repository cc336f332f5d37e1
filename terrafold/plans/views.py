"""The library's collections as views of the driver's tables, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a cloud. pid numbers the lines of an order, which spreads over orders."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    return li.select(
        (F.col("l_orderkey") * 64 + F.row_number().over(order)).alias("pid"),
        ((F.col("l_partkey") % 100) + (F.col("l_discount") + 0.0) * 10).alias("x"),
        ((F.col("l_suppkey") % 100) + (F.col("l_tax") + 0.0) * 10).alias("y"),
        F.col("l_quantity").cast("double").alias("z"),
        (F.col("l_partkey") % 256).alias("r"),
        (F.col("l_suppkey") * 2 % 256).alias("g"),
        (F.col("l_orderkey") % 256).alias("b"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 6).otherwise(5).alias("classification"),
    )


POINTS = """points AS (
  SELECT l_orderkey * 64 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pid,
    (l_partkey % 100) + (l_discount + 0.0) * 10 AS x, (l_suppkey % 100) + (l_tax + 0.0) * 10 AS y, CAST(l_quantity AS DOUBLE) AS z,
    l_partkey % 256 AS r, l_suppkey * 2 % 256 AS g, l_orderkey % 256 AS b,
    CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 6 ELSE 5 END AS classification
  FROM lineitem)"""


def near_sql(reach: float, a: str = "points", b: str = "points", extra: str = "") -> str:
    """near(pid, qid, d2): points of a and b nearer than reach, by cells of that size."""
    d2 = "(a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2"
    steps = ", ".join(f"(SELECT unnest([-1,0,1]) {d})" for d in ("da", "db", "dc"))
    left = f"SELECT pid, x, y, z, floor(x/{reach})+da AS ca, floor(y/{reach})+db AS cb, floor(z/{reach})+dc AS cc FROM {a}, {steps}"
    right = f"SELECT pid, x, y, z, floor(x/{reach}) AS ca, floor(y/{reach}) AS cb, floor(z/{reach}) AS cc FROM {b}"
    return f"near AS (SELECT a.pid, b.pid AS qid, b.x, b.y, b.z, {d2} AS d2 FROM ({left}) a JOIN ({right}) b USING (ca, cb, cc) WHERE {d2} < {reach}*{reach}{extra})"


def cells(spark: SparkSession, sf_dir: str, gsd: float = 4.0) -> DataFrame:
    """Mean heights on a grid whose north-west corner is (0, 104)."""
    from terrafold.operators.raster import rasterize

    return rasterize(points(spark, sf_dir), gsd, 0.0, 104.0, 26, 26, "mean").select("row", "col", "z")


CELLS = POINTS + """, cells AS (
  SELECT CAST(CASE WHEN y = 0 THEN 25 ELSE floor((104.0 - y) / 4.0) END AS BIGINT) AS row, CAST(CASE WHEN x = 104 THEN 25 ELSE floor(x / 4.0) END AS BIGINT) AS col, avg(z) AS z
  FROM points WHERE x >= 0 AND x <= 104 AND y >= 0 AND y <= 104 GROUP BY 1, 2)"""


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells with about a fifth of them missing."""
    return cells(spark, sf_dir).where((F.col("row") * 7 + F.col("col") * 3) % 5 != 0)


HOLED = CELLS + """, holed AS (SELECT * FROM cells WHERE (row * 7 + col * 3) % 5 <> 0)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pt"), F.col("l_suppkey").alias("image_id")).distinct()


OBSERVATIONS = """observations AS (SELECT DISTINCT l_partkey AS pt, l_suppkey AS image_id FROM lineitem)"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("seq"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("sharpness"), F.col("event_type").alias("kind"), k.alias("k"))


CAPTURES = """captures AS (SELECT user_id AS seq, event_id AS id, epoch_us(ts) / 1e6 AS t, value AS sharpness, event_type AS kind, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


def edges(spark: SparkSession, sf_dir: str, least: int = 2) -> DataFrame:
    """Suppliers that share parts: (id_a, id_b, inliers)."""
    from terrafold.operators.graph import used_pairs

    return used_pairs(observations(spark, sf_dir)).where(F.col("shared") >= least).select(F.col("image_a").alias("id_a"), F.col("image_b").alias("id_b"), F.col("shared").alias("inliers"))


EDGES = OBSERVATIONS + """, edges AS (
  SELECT a.image_id AS id_a, b.image_id AS id_b, count(*) AS inliers FROM observations a JOIN observations b ON a.pt = b.pt AND a.image_id < b.image_id GROUP BY 1, 2 HAVING count(*) >= 2)"""


def territories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): regions and their nations, nations and their customers and suppliers, and the next nation of a region."""
    n, c, s = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    region, nation, customer, supplier = (F.lit(k * 1_000_000_000).cast("bigint") for k in (1, 2, 3, 4))
    after = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    parts = [
        n.select((region + F.col("n_regionkey")).alias("id_a"), (nation + F.col("n_nationkey")).alias("id_b")),
        n.select((nation + F.col("n_nationkey")).alias("id_a"), (nation + F.lead("n_nationkey").over(after)).alias("id_b")).where("id_b is not null"),
        c.select((nation + F.col("c_nationkey")).alias("id_a"), (customer + F.col("c_custkey")).alias("id_b")),
        s.select((nation + F.col("s_nationkey")).alias("id_a"), (supplier + F.col("s_suppkey")).alias("id_b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


TERRITORIES = """edges AS (
  SELECT CAST(1000000000 + n_regionkey AS BIGINT) AS id_a, CAST(2000000000 + n_nationkey AS BIGINT) AS id_b FROM nation
  UNION ALL SELECT * FROM (SELECT 2000000000 + n_nationkey, 2000000000 + lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation) WHERE b IS NOT NULL
  UNION ALL SELECT 2000000000 + c_nationkey, 3000000000 + c_custkey FROM customer
  UNION ALL SELECT 2000000000 + s_nationkey, 4000000000 + s_suppkey FROM supplier)"""


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against their customers, as three residuals by segment; some heights are missing."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    k = F.col("o_orderkey")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(k.alias("id"), F.col("c_mktsegment").alias("segment"), ((F.col("o_totalprice") % 97) / 97 - 0.5).alias("dx"), ((F.col("o_totalprice") % 89) / 89 - 0.45).alias("dy"), F.when(k % 7 != 0, (F.col("c_acctbal") % 83) / 83 - 0.5).alias("dz"))


RESIDUALS = """residuals AS (
  SELECT o_orderkey AS id, c_mktsegment AS segment, (o_totalprice % 97) / 97 - 0.5 AS dx, (o_totalprice % 89) / 89 - 0.45 AS dy, CASE WHEN o_orderkey % 7 <> 0 THEN (c_acctbal % 83) / 83 - 0.5 END AS dz
  FROM orders JOIN customer ON o_custkey = c_custkey)"""
