"""Streaming, source and planner queries on the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.plans import views as V
from terrafold.plans.register import Catalog
from terrafold.sources import text as X
from terrafold.streaming import events as S

catalog = Catalog()
query = catalog.query


@query("SELECT strftime(time_bucket(INTERVAL 6 hours, ts), '%Y-%m-%d %H') AS start, event_type, count(*) n, round(sum(value),4) total FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    out = S.tumbling(V.table(spark, d, "events"), "6 hours")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH s AS (SELECT unnest(range(6)) k, time_bucket(INTERVAL 1 hour, ts) b, value FROM events) SELECT strftime(b - to_hours(k), '%Y-%m-%d %H') AS start, count(*) n, round(avg(value),6) mean FROM s GROUP BY 1")
def sliding_means(spark, d):
    out = S.sliding(V.table(spark, d, "events"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n", F.round("mean", 6).alias("mean"))


@query("WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) run FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS \"last\", count(*) n FROM r GROUP BY user_id, run")
def session_runs(spark, d):
    out = S.sessions(V.table(spark, d, "events"), "12 hours")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("start"), stamp("last"), "n")


@query("SELECT user_id, event_type, count(*) n FROM (SELECT DISTINCT user_id, event_type, date_trunc('day', ts) FROM events) GROUP BY 1, 2")
def daily_once(spark, d):
    e = V.table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return S.once(e, ["user_id", "event_type", "day"]).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) n, round(sum(value),4) total FROM events GROUP BY 1")
def streamed_totals(spark, d):
    """The same table read as a stream, drained, and totalled."""
    stream = S.replay(spark, f"{d}/events.parquet*").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return S.drain(stream, "streamed_totals", "complete").select("event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, count(*) n, round(sum(abs(d)),4) travel FROM (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) d FROM events) GROUP BY 1")
def stateful_motion(spark, d):
    events = S.replay(spark, f"{d}/events.parquet*").select("user_id", "value", F.struct("ts", "event_id").alias("order"))
    ordered = events.select("user_id", "value", F.concat(F.date_format("order.ts", "yyyyMMddHHmmssSSSSSS"), F.lpad(F.col("order.event_id").cast("string"), 20, "0")).alias("ts"))
    out = S.drain(S.motion(ordered), "stateful_motion", "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max("travel"), 4).alias("travel"))


_XYZ = "l_partkey || ' ' || l_suppkey || ' ' || l_quantity"


@query("SELECT l_partkey::DOUBLE x, l_suppkey::DOUBLE y, l_quantity::DOUBLE z, count(*) n FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1,2,3")
def xyz_parse(spark, d):
    """Text lines of coordinates, some of them comments, parsed back."""
    li = V.table(spark, d, "lineitem")
    line = F.concat_ws(" ", F.col("l_partkey"), F.col("l_suppkey"), F.col("l_quantity"))
    lines = li.select(F.when(F.col("l_linenumber") == 3, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))
    return X.parse_xyz(lines).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("n"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line FROM documents), c AS (SELECT doc_id, line, len(line)-len(replace(line,',','')) c, len(line)-len(replace(line,';','')) s, len(line)-len(replace(line,'|','')) p FROM l), t AS (SELECT doc_id, sum(c)::BIGINT commas, sum(s)::BIGINT semicolons, sum(p)::BIGINT pipes FROM c GROUP BY 1) SELECT doc_id, CASE WHEN pipes >= commas AND pipes >= semicolons AND pipes > 0 THEN '|' WHEN semicolons >= commas AND semicolons > 0 THEN ';' WHEN commas > 0 THEN ',' ELSE ' ' END delimiter FROM t")
def delimiter_sniff(spark, d):
    return X.sniff_delimiters(V.table(spark, d, "documents").select("doc_id", "text"))


@query("SELECT name, min(role) role, round(any_value(x),6) x, count(*) marks FROM (SELECT 'P' || (o_custkey % 50) AS name, CASE o_custkey % 3 WHEN 0 THEN 'check' ELSE 'control' END role, first_value(o_totalprice) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) x FROM orders WHERE o_custkey % 50 % 3 = o_custkey % 3) GROUP BY 1")
def gcp_groups(spark, d):
    o = V.table(spark, d, "orders").where("o_custkey % 50 % 3 = o_custkey % 3")
    rows = o.select(F.col("o_orderkey").alias("row"), F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")).alias("name"), F.when(F.col("o_custkey") % 3 == 0, "Check point").otherwise("GCP").alias("role"), F.col("o_totalprice").alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("z"), F.col("o_orderpriority").alias("image"), F.lit(1.0).alias("px"), F.lit(1.0).alias("py"))
    return X.build_gcps(rows).select("name", "role", F.round("x", 6).alias("x"), F.size("marks").cast("bigint").alias("marks"))
