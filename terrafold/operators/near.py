"""Neighbourhoods without pairs: each distinct place once, by tiles with their surroundings, in numpy.

A table of pairs grows with the square of a cloud's density. Here equal coordinates are one place
with a weight, places are dealt to tiles (some reaches wide) and those around them, and a task works
through its tiles in chunks of pairs, so that only what is asked of a place leaves it. Distances are
those of the pairs' join, in the same order of operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of whole tiles that are solved together, and pairs that are held at once.
ROWS, PAIRS = 40_000, 1 << 20
#: Cells are this much wider than asked, so that rounding moves no neighbour out of reach.
SLACK = 1 + 1e-9


def places(points: DataFrame, dims: str = "xyz", *more: Column) -> DataFrame:
    """(x, y(, z), w, more): distinct places of finite coordinates, with the number of their points."""
    known = points.where(" and ".join(f"abs({d}) < 1e300" for d in dims))
    return known.groupBy(*[F.col(d).cast("double").alias(d) for d in dims]).agg(F.count(F.lit(1)).alias("w"), *more)


def at_places(points: DataFrame, found: DataFrame, dims: str = "xyz", how: str = "inner") -> DataFrame:
    """points with what was found at their places.

    They meet by a hash of the place, which sorts as one number; the places themselves are compared where they meet.
    """

    def spot(names: list[str]) -> Column:
        at = [F.col(d).cast("double") + 0.0 for d in names]
        return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in at]), F.xxhash64(*at))

    other = [f"_{d}" for d in dims]
    named = found.withColumnsRenamed(dict(zip(dims, other, strict=True))).withColumn("_place", spot(other))
    # A difference, as an equality would be one more key to sort by.
    met = [spot(list(dims)) == F.col("_place"), *[F.col(d).cast("double") - F.col(o) == 0 for d, o in zip(dims, other, strict=True)]]
    return points.join(named, met, how).drop("_place", *other)


def by_tiles(rows: DataFrame, reach: float, solve: Callable, schema: str, dims: str = "xyz", across: int = 4) -> DataFrame:
    """What solve(tile, at, id of those that ask; tile, at, id, w of the others) yields, by tiles.

    rows: dims, id, w (its weight as another's neighbour, 0 for none), ask (boolean). Those of a tile that ask
    meet all rows of a weight within reach of the tile, which is so many reaches across.
    """
    side = across * reach * SLACK
    wide = F.when(F.col("w") > 0, reach * SLACK).otherwise(0.0)
    spot = lambda c: F.floor(c / side).cast("bigint")
    dealt = rows.select(*dims, F.col("id").cast("bigint").alias("id"), F.col("w").cast("bigint").alias("w"), "ask")
    for d in dims:
        dealt = dealt.withColumn(f"t{d}", F.explode(F.sequence(spot(F.col(d) - wide), spot(F.col(d) + wide))))
    own = F.col("ask")
    for d in dims:
        own = own & (F.col(f"t{d}") == spot(F.col(d)))
    tile = [f"t{d}" for d in dims]
    spark = rows.sparkSession
    # A given number of parts: their work isn't told by their bytes.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # A hash sorts as one number; tiles that share one are told apart below.
    dealt = dealt.withColumns({"own": own, "key": F.xxhash64(*tile)}).repartition(parts, "key").sortWithinPartitions("key")
    names = [s.split()[0] for s in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []
        held, limit = 0, 2 * ROWS

        def flush(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal rest, held, limit
            columns = [np.concatenate(c) for c in zip(*rest, strict=True)]
            key = columns[0]
            new = key[1:] != key[:-1]
            cut = len(key) if whole else int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            rest, held = [[c[cut:] for c in columns]], len(key) - cut
            limit = max(2 * ROWS, 2 * held)  # a tile of more rows is looked at again when it has doubled
            if cut:
                g, columns = numbered([c[:cut] for c in columns], len(dims))
                at = np.stack(columns[1 + len(dims) : 1 + 2 * len(dims)], axis=1)
                ident, w, q = columns[-3:]
                o = w > 0
                if q.any() and o.any():
                    for out in solve(g[q], at[q], ident[q], g[o], at[o], ident[o], w[o]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

        for b in batches:
            if b.num_rows:
                rest.append([b.column(c).to_numpy(zero_copy_only=False) for c in ("key", *tile, *dims, "id", "w", "own")])
                held += b.num_rows
                if held > limit:
                    yield from flush(False)
        if rest:
            yield from flush(True)

    return dealt.select("key", *tile, *dims, "id", "w", "own").mapInArrow(run, schema)


def numbered(columns: list[np.ndarray], dims: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of its tile of each row, columns in the order of tiles) of columns in the order of their first, the tiles' hash, and then a tile's numbers."""
    key, t = columns[0], np.stack(columns[1 : 1 + dims], axis=1)
    new = (t[1:] != t[:-1]).any(axis=1)
    if (new & (key[1:] == key[:-1])).any():
        order = np.lexsort((*t.T, key))
        columns, t = [c[order] for c in columns], t[order]
        new = (t[1:] != t[:-1]).any(axis=1)
    return np.cumsum(np.append(False, new)), columns


def met(gq: np.ndarray, q: np.ndarray, go: np.ndarray, o: np.ndarray, cell: float, steps: int) -> Iterator[tuple]:
    """(queries, others, d2) of all pairs at most `steps` cells apart, the pairs of a query together.

    Yields numbers of queries (ascending in their order here) with the pairs' numbers and squared distances.
    """
    dims = q.shape[1]
    kq, ko = np.floor(q / cell).astype(np.int64), np.floor(o / cell).astype(np.int64)
    # Cells count from each tile's lowest, so that their numbers stay small.
    low = np.full((int(max(gq.max(), go.max())) + 1, dims), np.iinfo(np.int64).max)
    np.minimum.at(low, gq, kq)
    np.minimum.at(low, go, ko)
    kq, ko = kq - low[gq] + steps, ko - low[go] + steps
    span = np.maximum(kq.max(axis=0), ko.max(axis=0)) + steps + 1

    def key(g, k):
        out = g.astype(np.int64)
        for d in range(dims):
            out = out * span[d] + k[:, d]
        return out

    key_o = key(go, ko)
    by_o = np.argsort(key_o, kind="stable")
    key_o, o = key_o[by_o], o[by_o]
    key_q = key(gq, kq)
    by_q = np.argsort(key_q, kind="stable")
    cells, first = np.unique(key_q[by_q], return_index=True)
    per = np.diff(np.append(first, len(by_q)))
    # The others of a query lie in runs: along the last dimension cells are neighbours in the order.
    shift = np.zeros(1, dtype=np.int64)
    for d in range(dims - 1):
        shift = (shift[:, None] * span[d] + np.arange(-steps, steps + 1)[None]).ravel()
    base = cells[:, None] + shift[None] * span[-1]
    start, stop = np.searchsorted(key_o, base - steps), np.searchsorted(key_o, base + steps, side="right")
    count = stop - start
    each = count.sum(axis=1)
    cell_of = np.repeat(np.arange(len(cells)), per)
    upto = np.cumsum(each[cell_of])
    at = 0
    while at < len(by_q):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        own = cell_of[at:end]
        n = count[own].ravel()
        total = int(n.sum())
        if total:
            begin = np.cumsum(n) - n
            j = np.arange(total) + np.repeat(start[own].ravel() - begin, n)
            i = np.repeat(np.arange(end - at), each[own])
            mine = q[by_q[at:end]]
            d2 = None
            for d in range(dims):
                x = mine[:, d][i] - o[:, d][j]
                d2 = x * x if d2 is None else d2 + x * x
            yield by_q[at:end], i, by_o, j, d2
        at = end


def on_lines(q: np.ndarray, o: np.ndarray, w: np.ndarray, reach: float) -> tuple | None:
    """(n, [cxx..czz]) as around gives them, of the queries q (all of them among o) of one tile, without pairs.

    Where coordinates repeat, places lie on lines along an axis, and those nearer than reach on a line are a run of
    it: sums of a run are a difference of sums up to its ends. Runs end where the pairs' own distances, in their order
    of operations, reach the limit. None if pairs are no dearer, or if a line weighs so much that differences lose digits.
    """
    r2, known = reach * reach, [np.unique(o[:, d]) for d in range(3)]
    c = max(range(3), key=lambda d: len(known[d]))
    a, b = (d for d in range(3) if d != c)
    na, nb, nc = (len(known[d]) for d in (a, b, c))
    if na * nb * nc > 16 * len(o):
        return None
    ask = [np.unique(q[:, d]) for d in range(3)]
    d2 = [(ask[d][:, None] - known[d][None]) ** 2 for d in range(3)]
    within = [x < r2 for x in d2]
    some = np.unique(np.searchsorted(ask[a], q[:, a]) * len(ask[b]) + np.searchsorted(ask[b], q[:, b]))
    steps = [np.unique(d2[d][within[d]]) for d in range(3)]
    # In units of a look at a run's ends: a pair of a cell around takes as long as two, a line's calls as 5,000.
    runs = within[a].sum() / len(ask[a]) * (within[b].sum() / len(ask[b])) * len(ask[c])
    around = np.prod([min(1.0, 2.5 * reach / max(known[d][-1] - known[d][0], reach)) for d in range(3)])
    if len(some) * (runs + 5000) > 2 * around * len(q) * len(o) or len(steps[a]) * len(steps[b]) > 1 << 22:
        return None
    sums = np.zeros((na * nb, nc + 1, 3))
    middle = (known[c][0] + known[c][-1]) / 2
    at = [np.searchsorted(known[d], o[:, d]) for d in range(3)]
    line, off = at[a] * nb + at[b], o[:, c] - middle
    for k in range(3):
        sums[line, at[c] + 1, k] = w * off**k
    np.cumsum(sums, axis=1, out=sums)
    if sums[:, -1, 0].max() > 1 << 14:
        return None
    sums = sums.reshape(-1, 3)
    # far[i, j]: how many of the steps along c are within reach, with the i-th step along a and the j-th along b.
    u, sa, sb = steps[c], steps[a][:, None], steps[b][None]

    def inside(k):
        part = {a: sa, b: sb, c: u[np.clip(k, 0, len(u) - 1)]}
        return (part[0] + part[1]) + part[2] < r2

    far = np.searchsorted(u, r2 - sa - sb)
    while (more := (far < len(u)) & inside(far)).any():
        far = far + more
    while (less := (far > 0) & ~inside(far - 1)).any():
        far = far - less
    # Ends of the run of each c that is asked for, by how many steps are within reach.
    count = np.arange(len(u) + 1)
    low, high = (np.empty((len(u) + 1, len(ask[c])), dtype=np.int64) for _ in range(2))
    for i, p in enumerate(np.searchsorted(known[c], ask[c])):
        rank = np.searchsorted(u, d2[c][i])
        high[:, i] = p + np.searchsorted(rank[p:], count)
        low[:, i] = p - np.searchsorted(rank[:p][::-1], count)
    rank = {d: np.searchsorted(steps[d], d2[d]) for d in (a, b)}
    near = {d: [np.flatnonzero(x) for x in within[d]] for d in (a, b)}
    found = np.zeros((len(ask[a]) * len(ask[b]), len(ask[c]), 6, 3))
    for s in some:
        i, j = divmod(int(s), len(ask[b]))
        la, lb = near[a][i], near[b][j]
        k = far[rank[a][i, la][:, None], rank[b][j, lb][None]]
        ka, kb = np.nonzero(k)
        k, la, lb = k[ka, kb], la[ka], lb[kb]
        base = ((la * nb + lb) * (nc + 1))[:, None]
        run = np.take(sums, base + high[k], axis=0) - np.take(sums, base + low[k], axis=0)
        da, db = known[a][la] - ask[a][i], known[b][lb] - ask[b][j]
        total = np.stack((np.ones(len(da)), da, db, da * da, da * db, db * db)) @ run.reshape(len(da), -1)
        found[s] = total.reshape(6, -1, 3).transpose(1, 0, 2)
    mine = [np.searchsorted(ask[d], q[:, d]) for d in range(3)]
    total = found[mine[a] * len(ask[b]) + mine[b], mine[c]]
    n = total[:, 0, 0]
    total = total / n[:, None, None]
    mean = {a: total[:, 1, 0], b: total[:, 2, 0], c: total[:, 0, 1]}
    product = {(a, a): total[:, 3, 0], (a, b): total[:, 4, 0], (b, b): total[:, 5, 0], (a, c): total[:, 1, 1], (b, c): total[:, 2, 1], (c, c): total[:, 0, 2]}
    both = lambda i, j: product[i, j] if (i, j) in product else product[j, i]
    return n, [both(i, j) - mean[i] * mean[j] for i in range(3) for j in range(i, 3)]


def around(points: DataFrame, reach: float) -> DataFrame:
    """(x, y, z, n, nearest) of every place: of the points nearer than reach.

    n counts them, the place's own included; nearest: the least squared distance to another point, null without any.
    """

    def solve(gq, q, _, go, o, __, w):
        for own, i, by_o, j, d2 in met(gq, q, go, o, reach / 2 * SLACK, 2):
            inside = np.flatnonzero(d2 < reach * reach)
            i, j, d2 = i[inside], by_o[j[inside]], d2[inside]
            n = np.bincount(i, weights=w[j], minlength=len(own))  # at least the place itself
            other = (d2 > 0) | (w[j] > 1)
            nearest = np.full(len(own), np.inf)
            np.minimum.at(nearest, i[other], d2[other])
            yield [*q[own].T, n.astype(np.int64), pa.array(nearest, mask=np.isinf(nearest))]

    rows = places(points).withColumns({"id": F.lit(0), "ask": F.lit(True)})
    return by_tiles(rows, reach, solve, "x double, y double, z double, n bigint, nearest double")


def spread(points: DataFrame, reach: float, tell: Callable, schema: str) -> DataFrame:
    """(x, y, z, what tell gives) of every place, worked out once.

    tell(n, [cxx..czz]): from the number of the points nearer than reach, the place's own included, and their
    covariance, columns of the schema.
    """

    def solve(gq, q, _, go, o, __, w):
        left = np.ones(int(max(gq[-1], go[-1])) + 1, dtype=bool)
        edges = [np.searchsorted(g, np.arange(len(left) + 1)) for g in (gq, go)]
        for g in range(len(left)):
            mine, others = (slice(e[g], e[g + 1]) for e in edges)
            if mine.start < mine.stop and (told := on_lines(q[mine], o[others], w[others], reach)):
                left[g] = False
                yield [*q[mine].T, *tell(*told)]
        gq, q, go, o, w = gq[left[gq]], q[left[gq]], go[left[go]], o[left[go]], w[left[go]]
        if not len(q):
            return
        for own, i, by_o, j, d2 in met(gq, q, go, o, reach / 2 * SLACK, 2):
            inside = np.flatnonzero(d2 < reach * reach)
            i, j = i[inside], by_o[j[inside]]
            wj, size = w[j], len(own)
            total = lambda v: np.bincount(i, weights=v, minlength=size)  # noqa: B023, E731
            n = total(wj)  # at least the place itself
            off = [o[j, d] - q[own, d][i] for d in range(3)]
            mean = [total(wj * x) / n for x in off]
            yield [*q[own].T, *tell(n, [total(wj * off[a] * off[b]) / n - mean[a] * mean[b] for a in range(3) for b in range(a, 3)])]

    rows = places(points).withColumns({"id": F.lit(0), "ask": F.lit(True)})
    return by_tiles(rows, reach, solve, f"x double, y double, z double, {schema}", across=6)


def decimals(v: np.ndarray, digits: int | None) -> np.ndarray:
    """v rounded, halves away from zero; as it is without digits."""
    return v if digits is None else np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5), v) / 10.0**digits + 0.0


def closest(gq, q, go, o, ident, w, reach: float, k: int, strict: bool, less: Callable) -> Iterator[tuple]:
    """(query, other, d2, take): of each query the k nearest others within reach, ties to the smaller id.

    take: how many of the other's weight are among the k. less(query, other, d2, w): the weight an other has for
    a query. Cells start small where others are dense; a query that finds k within a cell's width is
    done, the rest look again in cells twice as wide, up to the reach.
    """
    dims = q.shape[1]
    wide = reach * SLACK
    scale = 0
    for s in range(8, 0, -1):
        cells = len(np.unique(np.column_stack((go, np.floor(o / (wide / 2**s)))), axis=0)) if len(o) else 1
        if len(o) / cells * 3**dims >= 4 * k:
            scale = s
            break
    left = np.arange(len(q))
    while len(left):
        cell, last = wide / 2**scale, scale == 0
        sure = reach * reach if last else (cell * (1 - 1e-9)) ** 2
        again = []
        seen = np.zeros(len(left), dtype=bool)
        for own, i, by_o, j, d2 in met(gq[left], q[left], go, o, cell, 1):
            seen[own] = True
            inside = np.flatnonzero((d2 < sure) if strict or not last else (d2 <= sure))
            i, j, d2 = i[inside], by_o[j[inside]], d2[inside]
            mine = left[own]
            wj = less(mine[i], j, d2, w[j])
            if not last:
                short = np.bincount(i, weights=wj, minlength=len(own)) < k
                again.append(mine[short])
                i, j, d2, wj = (v[~short[i]] for v in (i, j, d2, wj))
            some = wj > 0
            i, j, d2, wj = (v[some] for v in (i, j, d2, wj))
            if not len(i):
                continue
            order = np.lexsort((ident[j], d2, i))
            i, j, d2, wj = (v[order] for v in (i, j, d2, wj))
            upto = np.cumsum(wj)
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            before = upto - wj - np.repeat((upto - wj)[first], np.diff(np.append(first, len(i))))
            take = np.clip(k - before, 0, wj)
            good = take > 0
            yield mine[i[good]], j[good], d2[good], take[good]
        if not last:
            again.append(left[~seen])
        left, scale = (np.concatenate(again) if again else np.zeros(0, np.int64)), scale - 1


def nearest_means(points: DataFrame, reach: float, k: int) -> DataFrame:
    """(x, y, z, w, mean) of every place: the mean distance of a point there to its k nearest others within reach."""

    def solve(gq, q, own, go, o, ident, w):
        total, taken = np.zeros(len(q)), np.zeros(len(q))
        for i, _, d2, take in closest(gq, q, go, o, ident, w, reach, k, True, lambda i, j, d2, w: w - (d2 == 0)):
            total += np.bincount(i, weights=np.sqrt(d2) * take, minlength=len(q))
            taken += np.bincount(i, weights=take, minlength=len(q))
        met_any = taken > 0
        # A place asks under its weight.
        yield [*q[met_any].T, own[met_any], total[met_any] / taken[met_any]]

    rows = places(points).withColumns({"id": F.col("w"), "ask": F.lit(True)})
    return by_tiles(rows, reach, solve, "x double, y double, z double, w bigint, mean double")


def nearest_of(source: DataFrame, reference: DataFrame, reach: float) -> DataFrame:
    """(x, y, z, d2, qid) of every place of the source: the nearest reference nearer than reach, ties to the smaller pid."""
    both = source.select("x", "y", "z", F.lit(None).cast("bigint").alias("qid")).unionByName(reference.select("x", "y", "z", F.col("pid").cast("bigint").alias("qid")))
    found = places(both, "xyz", F.min("qid").alias("id"), F.max(F.col("qid").isNull()).alias("ask"))

    def solve(gq, q, _, go, o, ident, w):
        for i, j, d2, __ in closest(gq, q, go, o, ident, w, reach, 1, True, lambda i, j, d2, w: w):
            yield [*q[i].T, d2, ident[j]]

    rows = found.select("x", "y", "z", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNotNull().cast("bigint").alias("w"), "ask")
    return by_tiles(rows, reach, solve, "x double, y double, z double, d2 double, qid bigint")


def nearest_items(items: DataFrame, k: int, reach: float) -> DataFrame:
    """(id, other): the k nearest other items of each within reach (its end included), ties to the smaller id (items: id, x, y).

    Of a place's items only the k + 1 smallest ids can be among the nearest of any.
    """
    known = items.where("abs(x) < 1e300 and abs(y) < 1e300")
    turn = F.row_number().over(Window.partitionBy("x", "y").orderBy("id"))
    rows = known.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).withColumn("turn", turn)

    def solve(gq, q, own, go, o, ident, w):
        for i, j, _, __ in closest(gq, q, go, o, ident, w, reach, k, False, lambda i, j, d2, w: (own[i] != ident[j]).astype(np.int64)):
            yield [own[i], ident[j]]

    rows = rows.withColumns({"w": (F.col("turn") <= k + 1).cast("bigint"), "ask": F.lit(True)})
    return by_tiles(rows, reach, solve, "id bigint, other bigint", "xy")
