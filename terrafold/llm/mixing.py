"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

Sizes are words. Targets share the whole size by weight; a target stops at `ceiling` times its
source's size and the excess is shared again. Blocks of `block` words, or of fewer if the smallest
target would have under LEAST_BLOCKS of them, are then allotted by highest quotients
target / (2 s + 1), first to sources, then to the shards of each source (pieces of a source dealt
by a hash), and each shard draws its quota of blocks with a seed: every block quota // n times,
and quota % n of them once more. A document takes the words of its blocks. So a source's words
are within a block of its target, unless its shards are drawn in full.

Bounds: a shard holds about `shard_words` words or `shard_rows` rows, or more when the corpus
would else have over MAX_SHARDS shards; the driver sees a row for each source and shard.
Sources are the mixture's configuration: over `max_sources` of them is an error.

A null or empty text has size 0 and takes 0. Null sources are one source, the last. Rows that
are the same in all columns are numbered and dealt like others, so any number of them is spread
over the shards; which of them takes what is left open. A very long text is one document of many
blocks. Other columns of the input play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import WORD, materialize, plain

MAX_SHARDS = 1 << 18
#: The smallest target is at least so many blocks, or blocks are single words.
LEAST_BLOCKS = 64
#: Equal rows that one row is expanded to in one step.
EQUAL = 1 << 16


def targets(sizes: np.ndarray, weights: np.ndarray, ceiling: float = 3.0) -> np.ndarray:
    """Shares of the whole size by weight, none above ceiling * its size."""
    out = np.zeros(len(sizes))
    free = np.ones(len(sizes), dtype=bool)
    total = float(sizes.sum())
    while free.any():
        rest = total - out[~free].sum()
        share = rest * weights[free] / weights[free].sum()
        over = share > ceiling * sizes[free]
        if not over.any():
            out[free] = share
            break
        at = np.flatnonzero(free)[over]
        out[at] = ceiling * sizes[at]
        free[at] = False
    return out


def apportion(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: each seat goes to the highest votes / (2 s + 1); nobody gets over `most`.

    Equal quotients go to the smaller position. The divisor form gives nearly all seats at
    once, and a heap of quotients the last ones, or takes the lowest back.
    """
    votes, most = np.asarray(votes, dtype=float), np.asarray(most, dtype=np.int64)
    seats = int(min(seats, most[votes > 0].sum()))
    got = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return got
    low, high = 0.0, votes.max() * 2 + 1  # divisors: too many seats, too few
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        if np.minimum(np.floor(votes / mid + 0.5), most).sum() > seats:
            low = mid
        else:
            high = mid
    # A slightly larger divisor leaves equal quotients to the heap, which breaks ties by position.
    got = np.minimum(np.floor(votes / (high * (1 + 1e-9)) + 0.5), most).astype(np.int64)
    heap = [(-votes[k] / (2 * got[k] + 1), k) for k in np.flatnonzero((got < most) & (votes > 0))]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        _, k = heapq.heappop(heap)
        got[k] += 1
        if got[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * got[k] + 1), k))
    return got


def draw(size: np.ndarray, quota: int, block: int, seed: list[int], ceiling: int = 3) -> np.ndarray:
    """Words each of a shard's documents, in this order, takes by `quota` blocks.

    The last block may be short: what it lacks is taken from the first words of the next blocks drawn.
    """
    ends = np.cumsum(size)
    n = -(-int(ends[-1]) // block) if len(ends) else 0
    if not n:
        return np.zeros(len(size), dtype=np.int64)
    times, more = np.full(n + 1, quota // n, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    drawn = np.random.default_rng(seed).permutation(n)
    times[drawn[: quota % n]] += 1
    times[n] = 0
    lengths = np.append(np.minimum(block, int(ends[-1]) - block * np.arange(n)), 0)
    short = quota * block - int((times * lengths).sum())
    for b in drawn[quota % n :] if short else ():
        if times[b] < ceiling and short:
            more[b] = min(short, lengths[b])
            short -= int(more[b])
    before = np.concatenate(([0], np.cumsum(times * lengths + more)))
    taken = lambda x: before[x // block] + times[x // block] * (x % block) + np.minimum(x % block, more[x // block])
    return taken(ends) - taken(ends - size)


def by_position(k: int) -> float:
    """1, 2, 3, repeating."""
    return float(k % 3 + 1)


def whole_copies(size: np.ndarray, taken: np.ndarray, ceiling: int) -> np.ndarray:
    """Copies of whole documents, in this order, whose running words follow the words taken."""
    out = np.zeros(len(size), dtype=np.int64)
    owed = 0.0
    for k, (s, t) in enumerate(zip(size.tolist(), taken.tolist(), strict=True)):
        owed += t
        out[k] = min(ceiling, max(0, int(owed / s + 0.5))) if s else 0
        owed -= out[k] * s
    return out


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `copy`: 0, 1, .. among rows that are the same in all columns.

    Rows are counted first; a row of very many copies is dealt in steps of EQUAL over the tasks.
    """
    counted = rows.groupBy(*[F.col(f"`{c}`") for c in rows.columns]).agg(F.count(F.lit(1)).alias("_m"))
    steps = counted.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / EQUAL)))).repartition("dealt", "_s")
    last = F.least(F.col("_m"), (F.col("_s") + 1) * EQUAL) - 1
    return steps.withColumn("copy", F.explode(F.sequence(F.col("_s") * EQUAL, last))).drop("_m", "_s")


def mix(
    docs: DataFrame,
    weight: Callable[[int], float] = by_position,
    block: int = 16,
    seed: int = 42,
    ceiling: int = 3,
    shard_words: int = 1 << 18,
    shard_rows: int = 1 << 16,
    max_sources: int = 1 << 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies, and the columns `keep`).

    copies: how often to write the whole document so that the source's words come near its
    target without cutting any text.

    weight: of the source at each position, in the order of code points with null last.
    """
    words_of = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = plain(docs, doc_id=id_col, source=F.col(f"`{source_col}`").cast("string"), size=words_of, dealt=F.xxhash64(f"`{id_col}`", f"`{text_col}`", F.lit(seed)), **{c: c for c in keep})
    sized = materialize(numbered(rows).withColumn("dealt", F.xxhash64("dealt", "copy")).drop("copy"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"over {max_sources} sources: group them, or raise max_sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    sizes = np.array([r["size"] for r in totals], dtype=np.int64)
    words, rows = int(sizes.sum()), sum(r["n"] for r in totals)
    target = targets(sizes, np.array([weight(k) for k in range(len(totals))])) if totals else np.zeros(0)
    shard_words, shard_rows = max(shard_words, words * 2 // MAX_SHARDS), max(shard_rows, rows * 2 // MAX_SHARDS)
    spark = docs.sparkSession
    found = pd.DataFrame({"source": [r["source"] for r in totals], "source_no": np.arange(len(totals)), "source_size": sizes, "target": target, "shards": [max(1, -(-int(r["size"]) // shard_words), -(-r["n"] // shard_rows)) for r in totals]}).astype({"source": object})
    sources = spark.createDataFrame(list(found.itertuples(index=False, name=None)) or [], "source string, source_no long, source_size long, target double, shards long")
    # A row for each source: at most max_sources, checked above.
    dealt = sized.join(F.broadcast(sources), sized["source"].eqNullSafe(sources["source"])).drop(sources["source"]).withColumn("shard", F.pmod("dealt", "shards"))
    cells = dealt.where("size > 0").groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect()  # at most MAX_SHARDS + sources rows
    quotas = []
    if cells:
        block = max(1, min(block, int(target[target > 0].min()) // LEAST_BLOCKS))
        seats = apportion(target, round(target.sum() / block), np.array([ceiling * int(s) // block for s in sizes]))
        own: dict[int, list] = {}
        for r in sorted(cells):
            own.setdefault(r["source_no"], []).append(r)
        for k, shards in own.items():
            size = np.array([r["size"] for r in shards], dtype=np.int64)
            got = apportion(size, int(seats[k]), ceiling * (-(-size // block)))
            quotas += [(k, r["shard"], int(q)) for r, q in zip(shards, got, strict=True)]
    quota = spark.createDataFrame(quotas, "source_no long, shard long, quota long")

    def select(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["dealt", "doc_id", "size"], kind="stable")
        pdf["taken"] = draw(pdf["size"].to_numpy(), int(pdf["quota"].iloc[0]), block, [seed, int(key[0]), int(key[1])], ceiling)
        pdf["copies"] = whole_copies(pdf["size"].to_numpy(), pdf["taken"].to_numpy(), ceiling)
        return pdf[["doc_id", "size", "source_size", "target", "taken", "source", "copies", *keep]]

    kinds = dict(sized.dtypes)
    schema = f"doc_id {kinds['doc_id']}, size bigint, source_size bigint, target double, taken bigint, source string, copies bigint" + "".join(f", `{c}` {kinds[c]}" for c in keep)
    chosen = dealt.where("size > 0").join(F.broadcast(quota), ["source_no", "shard"]).groupBy("source_no", "shard").applyInPandas(select, schema)
    nothing = dealt.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source", F.lit(0).cast("long").alias("copies"), *keep)
    return chosen.unionByName(nothing)
