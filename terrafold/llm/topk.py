"""Exact top-k search with a pivot-distance index.

Vectors are integers (floor of `scale` times each component). Inner products become distances
with one more coordinate: a vector x gets sqrt(M^2 - |x|^2), M the largest norm, and a query 0,
so that |q - x|^2 = |q|^2 + M^2 - 2 <q, x>. The index keys every vector by its nearest pivot and
the distance to it; vectors with near distances form an annulus (more than a tile holds are dealt
into several). By the triangle inequality no vector of an annulus [low, high] around a pivot at
distance d from the query is nearer than max(low - d, d - high), so its score is at most
(|q|^2 + M^2 - that^2) / 2.

A query expands the annuli in the order of these bounds, in rounds of growing size. After each
round its k-th best score is known; it goes on only to annuli whose bound reaches that score and
stops where none is left. Scores are exact integers; bounds carry a margin for rounding. A round
is a join of the asked annuli with chunks of queries, each pair one matrix product; annuli that
no query of a chunk asks for are not sent to it.

The pivots come from a bounded sample (`sample` rows); every row is indexed. Tiles grow with the
table up to TILE_BYTES a side, and so do the pivots (to 512), which bounds the annuli: at most
256 for a pivot, a list that every task reads.

A row is a candidate of every query but itself, so rows of one id and vector count each, and
a repeated query row has its own results. Ties go to the smaller vec_id, a null one last; a row
without id is no query. Vectors that are null or hold a null or non-finite component take no part;
shorter vectors count as filled with zeros, and one of any length is worked on whole. Vectors so
long that a score might exceed a long are refused with an error. Fewer than k others: all of them.
Other columns play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import discard, materialize, plain, ragged

#: Products of integers below this are exact in float64.
EXACT = float(1 << 53)
#: Bytes of vectors in a side of a tile, and annuli that a query expands in its rounds.
TILE_BYTES, GROWTH = 32 << 20, 8


def unpack(rows, dim: int) -> np.ndarray:
    """Vectors from their little-endian int64 bytes, filled up to dim."""
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for k, raw in enumerate(rows):
        own = np.frombuffer(raw, dtype="<i8")
        out[k, : len(own)] = own
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < EXACT else a @ b.T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller position."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        over = np.flatnonzero(scores > edge)
        at = np.concatenate((over, np.flatnonzero(scores == edge)[: k - len(over)]))
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((at, -scores[at]))]


def integers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, norm2): the integer vector as bytes and its squared length; only vectors of finite components."""
    whole = plain(vectors, vec_id=F.col(f"`{id_col}`").cast("long"), x=F.col(f"`{vector_col}`").cast("array<double>"))
    finite = whole.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))

    def run(batches):
        for b in batches:
            whole = [np.floor(scale * np.array(x, dtype=float)) for x in b.column("x").to_pylist()]
            with np.errstate(over="ignore"):
                norms = [float((x * x).sum()) for x in whole]
            # What doesn't fit is refused by its length later on.
            out = [np.clip(x, -(2.0**62), 2.0**62).astype("<i8").tobytes() for x in whole]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "v", "norm2"])

    return finite.mapInArrow(run, "vec_id bigint, v binary, norm2 double")


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, pivots: int | None = None, sample: int = 8192, annulus: int | None = None, chunk: int | None = None, first: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score). is_query: a condition on vec_id.

    pivots, annulus, chunk: rows of each; by default they grow with the table.
    """
    spark = vectors.sparkSession
    rows = materialize(integers(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()))
    n, size, top2 = rows.agg(F.count(F.lit(1)), F.max(F.length("v")), F.max("norm2")).first()
    if not n:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    if top2 >= 2.0**62:
        raise ValueError("scores of vectors this long don't fit a long: scale them down")
    dim = max(1, size // 8)
    most = max(256, TILE_BYTES // (8 * dim))
    pivots = pivots or max(64, min(512, math.isqrt(n) // 64))
    annulus = annulus or max(1024, min(most, n // 1024))
    chunk = chunk or most
    u = F.shiftrightunsigned(F.xxhash64("row", F.lit(5)), 11).cast("double") / float(2**53)
    drawn = sorted(bytes(r["v"]) for r in rows.where(u <= min(1.0, sample / n)).select("v").limit(4 * sample).collect()) or [bytes(rows.first()["v"])]
    top2 *= 1 + 1e-12
    points = unpack(drawn, dim).astype(float)
    centres = _centres(np.column_stack((points, np.sqrt(np.maximum(top2 - (points**2).sum(axis=1), 0)))), pivots)

    def place(batches):
        for whole in batches:
            for at_row in range(0, whole.num_rows, 1000):
                b = whole.slice(at_row, 1000)
                x = unpack(b.column("v").to_pylist(), dim).astype(float)
                x = np.column_stack((x, np.sqrt(np.maximum(top2 - (x**2).sum(axis=1), 0))))
                d2 = (x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T
                at = d2.argmin(axis=1)
                away = np.sqrt(((x - centres[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("vec_id", "row", "v")), pa.array(at.astype(np.int32)), pa.array(away)], names=["vec_id", "row", "v", "pivot", "away"])

    keyed = "vec_id bigint, row bigint, v binary, pivot int, away double"
    placed = materialize(rows.mapInArrow(place, keyed))
    # Cut points of distance for each pivot by a sketch of quantiles; too many rows at one
    # distance are dealt further by a hash of the row.
    share = placed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("away", [i / 256 for i in range(257)], 2000).alias("q")).collect()  # a row for each pivot
    cuts = {r["pivot"]: np.unique(np.array(r["q"][:: max(1, 256 * annulus // max(annulus, r["n"]))])) for r in share}
    ring_of, total = {}, 0
    for p in sorted(cuts):
        ring_of[p] = total
        total += len(cuts[p])

    def ring(batches):
        for b in batches:
            pivot, away = b.column("pivot").to_numpy(), b.column("away").to_numpy()
            out = np.zeros(len(pivot), dtype=np.int64)
            for p in np.unique(pivot):
                own = pivot == p
                out[own] = ring_of[int(p)] + np.maximum(np.searchsorted(cuts[int(p)], away[own], side="right") - 1, 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*b.schema.names, "ring"])

    ringed = placed.mapInArrow(ring, f"{keyed}, ring bigint")
    found = ringed.groupBy("ring", "pivot").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.ceil(F.count(F.lit(1)) / most).cast("long").alias("parts")).orderBy("ring").toPandas()  # 256 a pivot
    rings, at_pivot, dealt = found["ring"].to_numpy(), found["pivot"].to_numpy(), found["parts"].to_numpy()
    low, high = found["low"].to_numpy(), found["high"].to_numpy()
    parts = F.broadcast(spark.createDataFrame([(int(r), int(d)) for r, d in zip(rings, dealt, strict=True)], "ring long, parts long"))  # 256 a pivot
    block = F.shiftleft("ring", 32) + F.pmod(F.xxhash64("row", F.lit(9)), "parts")
    index = materialize(ringed.join(parts, "ring").select(block.alias("block"), "vec_id", "row", "v"))

    queries = rows.where(is_query).select("vec_id", "row", "v")
    chunks = max(1, -(-queries.count() // chunk))
    queries = materialize(queries.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(chunks))))
    discard(rows, placed)

    def bounds(raw: list) -> np.ndarray:
        """The highest score each query can have in each annulus."""
        q = np.column_stack((unpack(raw, dim).astype(float), np.zeros(len(raw))))
        q2 = (q**2).sum(axis=1)
        d = np.sqrt(np.maximum(q2[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * q @ centres.T, 0))[:, at_pivot]
        margin = 1e-6 * (1 + d + np.maximum(low, high)[None, :])
        near = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]) - margin, 0)
        return (q2[:, None] + top2 - near**2) / 2 + 1e-9 * (q2[:, None] + top2) + 1

    def ask(start: int, stop: int):
        """The annuli at these places of each query's order whose bound reaches its floor."""

        def run(batches):
            for whole in batches:
                for at in range(0, whole.num_rows, 256):
                    b = whole.slice(at, 256)
                    most_score = bounds(b.column("v").to_pylist())
                    order = np.argsort(-most_score, axis=1, kind="stable")[:, start:stop]
                    floor = np.nan_to_num(b.column("floor").to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
                    who, place = np.nonzero(np.take_along_axis(most_score, order, axis=1) >= floor[:, None])
                    what = order[who, place]
                    who, block = np.repeat(who, dealt[what]), np.repeat(rings[what] << 32, dealt[what]) + ragged(dealt[what])
                    yield pa.RecordBatch.from_arrays([pa.array(block), *(b.column(c).take(pa.array(who)) for c in ("chunk", "vec_id", "row", "v"))], names=["block", "chunk", "vec_id", "row", "v"])

        return run

    def evaluate(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["vec_id", "row"], kind="stable", na_position="last")
        ids, own, x = left["vec_id"].astype("Int64").array, left["row"].to_numpy(), unpack(left["v"].tolist(), dim)
        out = []
        for at in range(0, len(right), 256) if len(own) else ():
            part = right.iloc[at : at + 256]
            scores = products(unpack(part["v"].tolist(), dim), x)
            for line, query, key in zip(scores, part["row"], part["vec_id"], strict=True):
                others = np.flatnonzero(own != query)
                top = others[best(line[others], k)] if len(others) < len(own) else best(line, k)
                out.append(pd.DataFrame({"query": query, "query_id": key, "vec_id": ids[top], "row": own[top], "score": line[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "row": [], "score": []}).astype("int64")

    result = "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint"
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    have, start, stop = spark.createDataFrame([], result).withColumn("rank", F.lit(0)), 0, first
    while start < len(rings):
        floors = have.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
        wanted = queries.join(floors, "row", "left").select("vec_id", "row", "v", "chunk", "floor").mapInArrow(ask(start, stop), "block bigint, chunk bigint, vec_id bigint, row bigint, v binary")
        wanted = materialize(wanted)
        tiles = materialize(wanted.select("block", "chunk").distinct())
        if tiles.isEmpty():
            discard(wanted, tiles)
            break
        body = index.join(tiles, "block")
        got = body.groupBy("block", "chunk").cogroup(wanted.groupBy("block", "chunk")).applyInPandas(evaluate, result)
        ranked = have.select(*got.columns).unionByName(got).withColumn("rank", F.row_number().over(order))
        found, old = materialize(ranked.where(F.col("rank") <= k)), have
        have = found
        discard(wanted, tiles, *([old] if start else []))
        start, stop = stop, stop * GROWTH
    return have.select("query_id", "rank", "vec_id", "score")


def _centres(points: np.ndarray, n: int) -> np.ndarray:
    """Pivots: a few rounds of k-means from seeded rows of the sample."""
    own = np.unique(points, axis=0)
    centres = own[np.random.default_rng(7).permutation(len(own))[:n]]
    for _ in range(8):
        d2 = (centres**2).sum(axis=1)[None, :] - 2 * own @ centres.T
        at = d2.argmin(axis=1)
        centres = np.array([own[at == j].mean(axis=0) if (at == j).any() else centres[j] for j in range(len(centres))])
    return centres
