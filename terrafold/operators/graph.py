"""Match graphs and tracks: degrees, components, bridges, co-visibility, residuals."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of intermediate data: the cluster's, or in local tests one of its own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if where:
        return where.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="terrafold-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df written as a table into the shared folder and read back, its lineage cut.

    Unlike a checkpoint a table keeps its statistics, so what follows is planned adaptively. The
    files go when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terrafold/{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree) of every node, and of ids that only edges name (edges: id_a, id_b)."""
    ends = edges.select(F.col("id_a").alias("id")).unionByName(edges.select(F.col("id_b").alias("id")))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").distinct().join(counts, "id", "full").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable.

    Min-label rounds with pointer jumping; labels are a table, and a round is two joins and an
    aggregation with partial minima. The number of rounds grows with the logarithm of the longest path.
    """
    both = settled(edges.where("id_a <> id_b").select("id_a", "id_b").unionByName(edges.where("id_a <> id_b").select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b"))).distinct())
    every = nodes.select("id").unionByName(both.select(F.col("id_a").alias("id"))).distinct()
    labels = settled(every.withColumn("component", F.col("id")))
    while True:
        near = both.join(labels.select(F.col("id").alias("id_b"), "component"), "id_b").groupBy(F.col("id_a").alias("id")).agg(F.min("component").alias("near"))
        lowered = labels.join(near, "id", "left").select("id", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        moved = settled(lowered.join(jump, "low").select("id", "component", F.least("low", "up").alias("next")))
        if moved.where("next <> component").isEmpty():
            return labels
        labels = moved.select("id", F.col("next").alias("component"))


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, size, rank, isolated, weakly): components largest first."""
    from pyspark.sql import Window

    degree = degrees(nodes, edges)
    found = components(nodes, edges).join(degree, "id").groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("degree") == 0).alias("isolated"), F.count_if(F.col("degree") == 1).alias("weakly"))
    return found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "component")))


def bridges(edges: DataFrame) -> DataFrame:
    """(id_a, id_b) whose removal parts the graph: low links of a depth-first search by component.

    A match graph has a node for each photograph, so a component fits one task.
    """
    whole = edges.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).where("id_a <> id_b").distinct()
    part = components(whole.select(F.col("id_a").alias("id")), whole)

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for a, b in zip(pdf["id_a"], pdf["id_b"], strict=True):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        seen, low, out, clock = {}, {}, [], 0
        for root in sorted(near):
            if root in seen:
                continue
            stack = [(root, None, iter(near[root]))]
            seen[root] = low[root] = clock = clock + 1
            while stack:
                node, parent, rest = stack[-1]
                for other in rest:
                    if other == parent:
                        continue
                    if other in seen:
                        low[node] = min(low[node], seen[other])
                    else:
                        seen[other] = low[other] = clock = clock + 1
                        stack.append((other, node, iter(near[other])))
                        break
                else:
                    stack.pop()
                    if parent is not None:
                        low[parent] = min(low[parent], low[node])
                        if low[node] > seen[parent]:
                            out.append((min(parent, node), max(parent, node)))
        return pd.DataFrame(out, columns=["id_a", "id_b"]).astype(pdf[["id_a", "id_b"]].dtypes.to_dict())

    kind = whole.schema["id_a"].dataType.simpleString()
    return whole.join(part, whole["id_a"] == part["id"]).select("id_a", "id_b", "component").groupBy("component").applyInPandas(find, f"id_a {kind}, id_b {kind}")


def used_pairs(observations: DataFrame) -> DataFrame:
    """(image_a, image_b, shared): points seen by both (observations: pt, image_id)."""
    o = observations.select("pt", "image_id").distinct()
    other = o.select("pt", F.col("image_id").alias("image_b"))
    return o.withColumnRenamed("image_id", "image_a").join(other, "pt").where("image_a < image_b").groupBy("image_a", "image_b").agg(F.count(F.lit(1)).alias("shared"))


def track_histogram(observations: DataFrame, last: int = 8) -> DataFrame:
    """(bin, n, pct): points by number of views, 2 to last ('8+'), empty bins kept."""
    spark = observations.sparkSession
    views = observations.groupBy("pt").agg(F.count_distinct("image_id").alias("v")).where("v >= 2").select(F.least("v", F.lit(last)).alias("k"))
    bins = spark.range(2, last + 1).select(F.col("id").alias("k"))
    counted = bins.join(views.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    label = F.when(F.col("k") == last, F.concat(F.col("k").cast("string"), F.lit("+"))).otherwise(F.col("k").cast("string"))
    return counted.join(F.broadcast(total)).select(label.alias("bin"), "n", F.when(F.col("total") > 0, F.col("n") * 100.0 / F.col("total")).otherwise(0.0).alias("pct"))


def residuals_by_image(images: DataFrame, residuals: DataFrame) -> DataFrame:
    """(image_id, n, rms, median, worst) of every image; nulls without observations.

    median: element n // 2 of the ascending residuals.
    """
    from terrafold.functions.stats import upper_median

    stats = residuals.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), upper_median("e").alias("median"), F.max("e").alias("worst"))
    return images.select("image_id").distinct().join(stats, "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def prune_short_tracks(observations: DataFrame, min_views: int = 3, grid: int = 16, min_supported: int = 50, min_share: float = 0.2) -> DataFrame:
    """Drops points of fewer than min_views views, unless they see an image cell no longer track covers.

    Only where enough points are supported. observations: pt, image_id, u, v in 0..1.
    """
    cell = [F.floor(F.least(F.col(c), F.lit(0.999999)) * grid).cast("bigint").alias(f"c{c}") for c in ("u", "v")]
    views = observations.groupBy("pt").agg(F.count_distinct("image_id").alias("views"))
    about = observations.join(views, "pt").select("pt", "image_id", "views", *cell)
    supported, total = views.agg(F.count_if(F.col("views") >= min_views), F.count(F.lit(1))).first()
    if supported < min_supported or supported < min_share * total:
        return observations
    covered = about.where(F.col("views") >= min_views).select("image_id", "cu", "cv").distinct()
    needed = about.where(F.col("views") < min_views).join(covered, ["image_id", "cu", "cv"], "left_anti").select("pt")
    kept = views.where(F.col("views") >= min_views).select("pt").unionByName(needed).distinct()
    return observations.join(kept, "pt", "left_semi")


def outdated(records: DataFrame, depth: int = 32) -> DataFrame:
    """(id) of records built before one of their inputs, or from an outdated one.

    records: id, built, based_on (array of ids). Staleness spreads along the edges until none is new.
    """
    edges = settled(records.select("id", "built", F.explode("based_on").alias("input")))
    inputs = records.select(F.col("id").alias("input"), F.col("built").alias("input_built"))
    stale = settled(edges.join(inputs, "input").where("input_built > built").select("id").distinct())
    for _ in range(depth):
        more = settled(edges.join(stale.withColumnRenamed("id", "input"), "input").select("id").unionByName(stale).distinct())
        if more.count() == stale.count():
            break
        stale = more
    return stale


def build_tracks(matches: DataFrame, least: int = 2) -> DataFrame:
    """(pt, image_id, kp): tie points as components of matched keypoints, without conflicts.

    matches: id_a, kp_a, id_b, kp_b. A photograph of which a component holds several keypoints
    leaves it; what keeps too few photographs goes. pt is the component's smallest node.
    """
    node = lambda i, k: F.shiftleft(F.col(i).cast("bigint"), 32) + F.col(k)
    edges = settled(matches.select(node("id_a", "kp_a").alias("id_a"), node("id_b", "kp_b").alias("id_b")))
    labels = components(edges.select(F.col("id_a").alias("id")), edges)
    seen = labels.select(F.col("component").alias("pt"), F.shiftright("id", 32).alias("image_id"), (F.col("id") % (1 << 32)).alias("kp"))
    single = seen.groupBy("pt", "image_id").agg(F.count(F.lit(1)).alias("n"), F.min("kp").alias("kp")).where("n = 1").select("pt", "image_id", "kp")
    enough = single.groupBy("pt").agg(F.count(F.lit(1)).alias("views")).where(F.col("views") >= least)
    return single.join(enough, "pt", "left_semi")


def extend_tracks(tracks: DataFrame, matches: DataFrame) -> DataFrame:
    """(pt, image_id, kp): keypoints matched to just one tie point join it, if their photograph is new there.

    Of several keypoints of a photograph for one point the smallest joins.
    """
    both = matches.select("id_a", "kp_a", "id_b", "kp_b").unionByName(matches.select(F.col("id_b").alias("id_a"), F.col("kp_b").alias("kp_a"), F.col("id_a").alias("id_b"), F.col("kp_a").alias("kp_b")))
    known = tracks.select("pt", F.col("image_id").alias("id_a"), F.col("kp").alias("kp_a"))
    free = both.join(known, ["id_a", "kp_a"]).join(tracks.select(F.col("image_id").alias("id_b"), F.col("kp").alias("kp_b")), ["id_b", "kp_b"], "left_anti")
    one = free.groupBy(F.col("id_b").alias("image_id"), F.col("kp_b").alias("kp")).agg(F.min("pt").alias("pt"), F.count_distinct("pt").alias("n")).where("n = 1")
    new = one.join(tracks.select("pt", "image_id"), ["pt", "image_id"], "left_anti").groupBy("pt", "image_id").agg(F.min("kp").alias("kp"))
    return tracks.select("pt", "image_id", "kp").unionByName(new)
