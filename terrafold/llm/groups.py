"""Links between the members of connected groups, by tiles that fit a task.

Members of a group (`root`) may be linked or not; a comparison decides for any two. All pairs
count, but pairs that other links join already need no comparison, so a group of copies costs
about its size, whatever its size:

1. A group is dealt into parts; each part is compared within.
2. The leading components of the parts of a large group are compared with each other by one
   member each, which joins a large component across its parts.
3. What is left: large components get parts of their own, the others share parts, and every two
   parts meet except those of one and the same component.

A group without links between its members is compared in full: its cost is its square over the
side of a tile in rows, and its square in cheap comparisons.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import discard, materialize

#: A side of a tile holds so many members and bytes of payload.
SIDE, SIDE_BYTES = 512, 8 << 20
#: Components of each part that are compared across parts first.
LEADERS = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of an edge. edges: a, b.

    Large-star and small-star steps in turn, until nothing changes. The minima are tables of
    their own, so that a join on a node of very many edges can be split.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            ends = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(ends)
        state = now
        both = materialize(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        near = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = materialize(both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        discard(old, both, near, large, low)


def _labelled(member: DataFrame, links: DataFrame) -> DataFrame:
    """member with label: its component by the links."""
    reach = materialize(components(links))
    return member.join(reach.withColumnRenamed("root", "label"), F.col("id") == F.col("node"), "left").withColumn("label", F.coalesce("label", "id")).drop("node")


def _compared(rows: DataFrame, payload: list[str], compare: Callable) -> DataFrame:
    """(a, b) from every tile. rows: root, p, q, second, label, id and the payload."""

    def run(batches):
        held, last = [], None

        def flush():
            ids = np.array([x[0] for x in held], dtype=np.int64)
            _, label = np.unique(np.array([x[1] for x in held], dtype=np.int64), return_inverse=True)
            second = np.array([x[2] for x in held])
            if label.max(initial=0) == 0 or (last[1] != last[2] and (second.all() or not second.any())):
                return []  # one component, or one side is empty
            one, two = compare([x[3:] for x in held], label, second if last[1] != last[2] else None)
            return [pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(ids[two])], names=["a", "b"])] if len(one) else []

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                columns = (b.column(c).to_pylist() for c in ("root", "p", "q", "id", "label", "second", *payload))
                for root, p, q, *x in zip(*columns, strict=True):
                    if (root, p, q) != last and held:
                        yield from flush()
                        held = []
                    last = root, p, q
                    held.append(x)
        if held:
            yield from flush()

    tiles = rows.select("root", "p", "q", "id", "label", "second", *payload)
    return tiles.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q").mapInArrow(run, "a bigint, b bigint")


def group_links(member: DataFrame, payload: list[str], compare: Callable, side: int = SIDE, side_bytes: int = SIDE_BYTES) -> DataFrame:
    """(a, b): links that connect just what `compare` links between any two members of a root.

    member: root, id (once), size (bytes) and the payload columns; a written table.
    compare(rows, label, second) gives the positions of links, as two arrays: enough of them
    to connect all linked rows, where rows of one label are connected already, and with
    `second` only pairs of both sides count. An empty table gives no links.
    """

    def parts(n: Column, size: Column) -> Column:
        return F.ceil(F.greatest(n / side, size / side_bytes)).cast("long")

    counted = parts(F.count(F.lit(1)), F.sum("size"))
    sizes = materialize(member.groupBy("root").agg(counted.alias("parts"), F.count(F.lit(1)).alias("n")).where("n > 1").select("root", "parts"))
    dealt = member.join(sizes, "root").withColumn("p", F.pmod(F.xxhash64(F.lit(1), "id"), "parts"))
    own = dealt.select("root", "p", F.col("p").alias("q"), F.lit(False).alias("second"), F.col("id").alias("label"), "id", *payload)
    links = materialize(_compared(own, payload, compare))
    large = sizes.where("parts > 1")
    if large.isEmpty():
        return links
    many = dealt.where("parts > 1").select("root", "p", "id", "size")
    known = materialize(_labelled(many, links))
    leading = known.groupBy("root", "p", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    order = Window.partitionBy("root", "p").orderBy(F.desc("n"), "label")
    leaders = materialize(leading.withColumn("k", F.row_number().over(order)).where(F.col("k") <= LEADERS).groupBy("root", "label").agg(F.min("id").alias("id")).select("root", "id"))
    if leaders.count() * 2 < known.count():
        among = materialize(member.join(leaders.select("id"), "id", "left_semi"))
        links = materialize(links.unionByName(group_links(among, payload, compare, side, side_bytes)))
        known = materialize(_labelled(many, links))
    # Large components have parts of their own, one after the other; the others share the first.
    by_label = known.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    alone = (F.col("n") * 2 >= side) | (F.col("bytes") * 2 >= side_bytes)
    of_label = by_label.withColumn("alone", alone).withColumn("own", parts(F.col("n"), F.col("bytes")))
    shared = of_label.groupBy("root").agg(F.coalesce(parts(F.sum(F.when(~F.col("alone"), F.col("n"))), F.sum(F.when(~F.col("alone"), F.col("bytes")))), F.lit(0)).alias("shared"), F.coalesce(F.sum(F.when(F.col("alone"), F.col("own"))), F.lit(0)).alias("apart"))
    before = Window.partitionBy("root").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2 / side of the members are components with parts of their own.
    spans = materialize(of_label.where("alone").withColumn("before", F.coalesce(F.sum("own").over(before), F.lit(0))).select("root", "label", "own", "before"))
    shared = materialize(shared)
    placed = known.join(spans, ["root", "label"], "left").join(shared, "root")
    draw = F.xxhash64(F.lit(2), "id")
    first = F.col("shared") + F.col("before")
    placed = placed.withColumn("part", F.when(F.col("own").isNull(), F.pmod(draw, "shared")).otherwise(first + F.pmod(draw, "own")))
    every = F.sequence(F.lit(0).cast("long"), F.col("shared") + F.col("apart") - 1)
    others = F.when(F.col("own").isNull(), every).otherwise(F.filter(every, lambda o: (o < first) | (o >= first + F.col("own"))))
    placed = placed.withColumn("other", F.explode(others)).select("id", "label", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), (F.col("part") > F.col("other")).alias("second"))
    return links.unionByName(_compared(member.join(placed, "id"), payload, compare))
