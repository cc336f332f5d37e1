"""SimHash near-duplicates by a binary trie self-join.

A fingerprint has a bit where over half of the text's shingle hashes (XXH64) have it. Distinct
fingerprints that differ in at most `budget` bits are linked, and linked ones form components.

The self-join walks pairs of trie nodes together, adds up the bits in which they differ and
leaves a pair as soon as the budget is exceeded. Two fingerprints within the budget agree in at
least one of budget + 1 blocks of bits, so with each block turned to the front in its turn only
pairs below the same first block are walked: a block's value is the key that spreads the work.
A block value with over `tile` fingerprints is split first: its node pairs are expanded eight
bits at a time as tables, with the same budget, until a pair has few enough. Each task walks
its group's pairs level by level in numpy and reports a spanning forest, not all pairs.
Components come from alternating star contractions over tables in the shared folder.

`similarity` asks for more than near fingerprints: texts whose five-word shingles agree in that
share. The walk finds candidates among them as above: texts of fingerprints within the budget are
connected. Such texts may also differ in many bits of a fingerprint, so one-permutation
MinHash (BINS bins) connects more: texts that share a band of ROWS whole minima. Both
only connect: all texts of a connected group are then held against each other, but for pairs
that other links join already (see groups), and those are linked whose sets of five-word shingles
agree. Sketches of a byte a bin spare the sets of clearly
unlike pairs. Every distinct fingerprint and sketch takes part.

Words are runs of anything but space and \\t..\\r, with A-Z in lower case; a text of fewer words
than a shingle is one shingle, one without words (or null) has fingerprint zero and is linked
like any other. Rows with the same fingerprint are one node. A null doc_id counts in no minimum
(a component of nulls alone has component_id null). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import materialize, plain
from terrafold.llm.groups import SIDE, components, group_links

SEED = 42


#: Bins of a sketch, and rows of the bands by which texts are sought: a pair of similarity s
#: shares none of the BINS // ROWS bands with a chance of (1 - s^ROWS)^(BINS // ROWS).
BINS, ROWS = 256, 6
EMPTY = np.uint64(2**64 - 1)
#: For each bin an order of all bins.
ORDERS = np.random.default_rng(SEED).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1)


def shingle_hashes(text: bytes, words: int, seed: int = SEED) -> np.ndarray:
    """The 64-bit hashes of all shingles, in order; none without words."""
    own = text.lower().split()  # bytes: ASCII case and ASCII white space only
    if not own:
        return np.zeros(0, dtype=np.uint64)
    n = max(1, len(own) - words + 1)
    joined = b" ".join(own)
    ends = np.cumsum([len(w) + 1 for w in own])
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[len(own) - n :] - 1
    digest, out = xxhash.xxh64_digest, []
    for at in range(0, n, 50_000):
        out += [np.frombuffer(b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 50_000].tolist(), stops[at : at + 50_000].tolist(), strict=True)]), dtype=">u8")]
    return np.concatenate(out)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes (big-endian) have."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 50_000):
        ones += np.unpackbits(hashes[at : at + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3, seed: int = SEED) -> int:
    return fingerprint_of(shingle_hashes(text, words, seed))


def five_of(hashes: np.ndarray) -> np.ndarray:
    """The hashes of five-word shingles, from those of three-word ones.

    Two three-word shingles two words apart make a five-word one; a text of under five words is
    one shingle.
    """
    h = hashes.astype(np.uint64)
    if not len(h):
        return h
    odd = lambda x: x * np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(29))
    five = odd(h[:-2]) + (odd(h[2:]) ^ np.uint64(0xD6E8FEB86659FD93)) * np.uint64(3) if len(h) > 2 else np.bitwise_xor.reduce(odd(h), keepdims=True)
    return odd(odd(five))


def minima_of(five: np.ndarray) -> np.ndarray:
    """The least hash of each of BINS bins; EMPTY for a bin without any."""
    low = np.full(BINS, EMPTY, dtype=np.uint64)
    np.minimum.at(low, (five >> np.uint64(56)).astype(np.int64), five & np.uint64((1 << 56) - 1))
    return low


def sketch_bytes(low: np.ndarray) -> bytes:
    """A byte a bin, 0 for an empty bin."""
    return np.where(low == EMPTY, 0, low % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes()


def sketch_of(hashes: np.ndarray) -> bytes:
    """One-permutation MinHash of the five-word shingles, from the hashes of three-word ones."""
    return sketch_bytes(minima_of(five_of(hashes)))


def bands_of(low: np.ndarray) -> np.ndarray:
    """A hash of each band of whole minima (signed); none without a shingle.

    An empty bin takes the minimum of the first filled one in an order of its own: else one
    shared shingle would make a band of short texts.
    """
    filled = low != EMPTY
    if not filled.any():
        return np.zeros(0, dtype=np.int64)
    if not filled.all():
        low = np.where(filled, low, low[ORDERS[np.arange(BINS), filled[ORDERS].argmax(axis=1)]])
    rows = low[: BINS // ROWS * ROWS].reshape(-1, ROWS)
    key = np.arange(len(rows), dtype=np.uint64)
    for column in rows.T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of bins that agree, of those that either text fills; rows of BINS bytes."""
    used = (a > 0) | (b > 0)
    return ((a == b) & used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), sketches: bool = False) -> DataFrame:
    """(doc_id, fp, and the columns `keep`) of every row; fp as a signed long.

    With sketches also sketch, bands, and body: the text in bytes.
    """

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                fp, sketch, bands = [], [], []
                for x in b.column(1).to_pylist():
                    h = shingle_hashes(x or b"", words)
                    fp.append(fingerprint_of(h))
                    if sketches:
                        low = minima_of(five_of(h))
                        sketch.append(sketch_bytes(low))
                        bands.append(bands_of(low))
                more = [pa.array(sketch, pa.binary()), b.column(1), pa.array(bands, pa.list_(pa.int64()))] if sketches else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), *more, *(b.column(c) for c in keep)], names=["doc_id", "fp", *(["sketch", "body", "bands"] if sketches else []), *keep])

    if sketches and words != 3:
        raise ValueError("sketches of five-word shingles are made of three-word ones")
    rows = plain(docs, doc_id=id_col, text=F.col(f"`{text_col}`").cast("binary"), **{c: c for c in keep})
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in [("doc_id", kinds["doc_id"]), ("fp", "bigint"), *([("sketch", "binary"), ("body", "binary"), ("bands", "array<bigint>")] if sketches else []), *((c, kinds[c]) for c in keep)])
    return rows.mapInArrow(run, schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            return label


def trie_pairs(v: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within the budget below the roots [lo, hi); v ascends in each."""
    return walk_pairs(v, np.stack((lo, hi, lo, hi, np.zeros(len(lo), dtype=np.int64))), 63, lambda bit: budget)


def walk_pairs(v: np.ndarray, pairs: np.ndarray, first: int, budget) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of leaves below the given node pairs that stay within the budget.

    pairs: rows lo1, hi1, lo2, hi2 and the bits in which the two nodes differ so far; v ascends
    in each node. first: the next bit to read. budget(bit): bits allowed once that bit is read.
    """
    lo1, hi1, lo2, hi2, err = pairs
    a, b = [], []
    for bit in range(first, -1, -1):
        if not len(lo1):
            break
        single = (hi1 - lo1 == 1) & (hi2 - lo2 == 1)
        if single.any():
            x, y = lo1[single], lo2[single]
            near = (x != y) & (np.bitwise_count(v[x] ^ v[y]) <= budget(0))
            a.append(x[near])
            b.append(y[near])
            lo1, hi1, lo2, hi2, err = (z[~single] for z in (lo1, hi1, lo2, hi2, err))
        ones = np.concatenate(([0], np.cumsum((v >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        mid1, mid2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        same = (lo1 == lo2) & (hi1 == hi2)
        both = np.stack((lo1, mid1, lo2, mid2, err)), np.stack((mid1, hi1, mid2, hi2, err))
        cross = np.stack((lo1, mid1, mid2, hi2, err + 1)), np.stack((mid1, hi1, lo2, mid2, err + 1))[:, ~same]
        step = np.concatenate((*both, *cross), axis=1)
        lo1, hi1, lo2, hi2, err = step[:, (step[0] < step[1]) & (step[2] < step[3]) & (step[4] <= budget(bit))]
        alone = (lo1 == lo2) & (hi1 - lo1 == 1) & (hi2 == hi1)
        lo1, hi1, lo2, hi2, err = (z[~alone] for z in (lo1, hi1, lo2, hi2, err))
    if len(lo1):  # all bits read: equal values or pairs within the budget
        a.append(lo1[lo1 != lo2])
        b.append(lo2[lo1 != lo2])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Positions in a and b of a spanning forest of n nodes that takes the nearest pairs first."""
    label, out = np.arange(n), []
    for level in np.unique(far):
        left = np.flatnonzero(far == level)
        while True:
            x, y = label[a[left]], label[b[left]]
            left = left[x != y]
            if not len(left):
                break
            x, y = label[a[left]], label[b[left]]
            high, low = np.maximum(x, y), np.minimum(x, y)
            # Each component but the smallest takes one pair to a smaller one: no cycles.
            pick = np.full(n, -1)
            pick[high] = np.arange(len(left))
            chosen = pick[pick >= 0]
            out.append(left[chosen])
            up = np.arange(n)
            up[high[chosen]] = low[chosen]
            while not np.array_equal(up, two := up[up]):
                up = two
            label = up[label]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def links_of(groups: np.ndarray, turn: np.ndarray, v: np.ndarray, budget: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of each group's links, as unturned fingerprints."""
    lo = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    hi = np.append(lo[1:], len(groups))
    cost = np.cumsum((hi - lo) ** 2)
    a, b = [], []
    for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(cost // 4_000_000)) + 1):
        first, last = lo[part[0]], hi[part[-1]]
        x, y = trie_pairs(v[first:last], lo[part] - first, hi[part] - first, budget)
        if len(x):
            label = forest(last - first, x, y)
            own = np.flatnonzero(label != np.arange(last - first))
            a.append(own + first)
            b.append(label[own] + first)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    shift = (turn * width).astype(np.uint64)
    back = lambda k: ((v[k] >> shift[k]) | np.where(shift[k] > 0, v[k] << ((np.uint64(64) - shift[k]) & np.uint64(63)), np.uint64(0))).view(np.int64)
    return back(x), back(y)


def walk(rows: DataFrame, budget: int, width: int) -> DataFrame:
    """rows: g (group), r (turn), v (turned fingerprint, signed). (a, b): links, a spanning forest."""

    def run(batches):
        rest: list[np.ndarray] = []
        held = 0

        def flush(everything: bool):
            nonlocal rest, held
            g, r, v = (np.concatenate(x) for x in zip(*rest, strict=True))
            cut = len(g) if everything else int(np.flatnonzero(g != g[-1])[-1] + 1) if (g != g[-1]).any() else 0
            if cut:
                # Signed order is not bit order: sort each group by its bits.
                order = np.lexsort((v[:cut].view(np.uint64), np.cumsum(np.append(0, np.diff(g[:cut]) != 0))))
                a, b = links_of(g[:cut], r[:cut], v[:cut].view(np.uint64)[order], budget, width)
                rest, held = [(g[cut:], r[cut:], v[cut:])], len(g) - cut
                if len(a):
                    return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])]
            return []

        for x in batches:
            if x.num_rows:
                rest.append(tuple(x.column(c).to_numpy() for c in ("g", "r", "v")))
                held += x.num_rows
                if held > 40_000:
                    yield from flush(False)
        if rest:
            yield from flush(True)

    return rows.repartition("g").sortWithinPartitions("g").select("g", "r", "v").mapInArrow(run, "a bigint, b bigint")


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame, budget: int = 3, tile: int = 2048) -> DataFrame:
    """(a, b): links that connect what pairs within the budget connect. fps: distinct fp."""
    if not 0 <= budget <= 15:
        raise ValueError("budget must be 0 to 15")
    blocks = 1 << (budget).bit_length()  # a power of two of equal blocks, more than the budget
    width = 64 // blocks
    fp = F.col("fp")
    turned = F.array(*[F.struct(F.lit(k).cast("long").alias("r"), (fp if not k else F.shiftleft(fp, k * width).bitwiseOR(F.shiftrightunsigned(fp, 64 - k * width))).alias("v")) for k in range(blocks)])
    rows = fps.select(F.explode(turned).alias("t")).select("t.r", "t.v")

    def node(depth: int) -> Column:
        return F.shiftrightunsigned("v", 64 - depth) if depth < 64 else F.col("v")

    group = F.shiftleft(F.col("r"), width).bitwiseOR(node(width))
    rows = rows.withColumn("g", group)
    hot = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tile).select("g"))
    if hot.isEmpty():
        return walk(rows, budget, width)
    out = walk(rows.join(hot, "g", "left_anti"), budget, width)
    # Groups of too many fingerprints: expand node pairs with their children, eight bits a step.
    large = materialize(rows.join(hot, "g", "left_semi").select("r", "v"))
    pairs, tasks = large.select("r", node(width).alias("a"), node(width).alias("b")).distinct(), []
    for depth in range(width + 8, 65, 8):
        child = large.groupBy("r", node(depth).alias("c"), node(depth - 8).alias("up")).agg(F.count(F.lit(1)).alias("n"))
        left, right = child.select("r", F.col("c").alias("ca"), F.col("up").alias("a"), F.col("n").alias("na")), child.select("r", F.col("c").alias("cb"), F.col("up").alias("b"), F.col("n").alias("nb"))
        wide = pairs.join(left, ["r", "a"]).join(right, ["r", "b"]).where((F.col("a") != F.col("b")) | (F.col("ca") <= F.col("cb"))).where(_differing("ca", "cb") <= budget)
        wide = materialize(wide.select("r", F.col("ca").alias("a"), F.col("cb").alias("b"), (F.col("na") + F.when(F.col("ca") == F.col("cb"), 0).otherwise(F.col("nb"))).alias("n")))
        done = wide if depth == 64 else wide.where(F.col("n") <= tile)
        tasks.append(done.select("r", F.lit(depth).alias("depth"), "a", "b"))
        pairs = wide.where(F.col("n") > tile).select("r", "a", "b")
        if depth == 64 or pairs.isEmpty():
            break
    every = tasks[0]
    for t in tasks[1:]:
        every = every.unionByName(t)
    # A pair's number: distinct from those of the other pairs.
    every = materialize(every.withColumn("g", F.monotonically_increasing_id()))
    sides = every.select("r", "depth", F.col("a").alias("node"), "g").unionByName(every.where("a <> b").select("r", "depth", F.col("b").alias("node"), "g"))
    depths = [width + 8 * (k + 1) for k in range(len(tasks))]
    spots = large.select("r", "v", F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), node(d).alias("node")) for d in depths])).alias("s")).select("r", "v", "s.depth", "s.node")
    return out.unionByName(walk(spots.join(sides, ["r", "depth", "node"]).select("g", "r", "v"), budget, width))


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b): links that connect all nodes that share a band. banded: id, bands.

    Each member of a band is linked to the smallest: rows grow with the members, not the pairs.
    Nothing is decided here: connected nodes are compared later, all.
    """
    keyed = banded.select("id", F.explode("bands").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("b")).where("n > 1").select("key", "b"))
    return keyed.join(shared, "key").where("id <> b").select(F.col("id").alias("a"), "b").distinct()


def share_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two ascending sets of hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def similar_forest(sketches: np.ndarray, sets: list[np.ndarray], label: np.ndarray, second: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of all pairs of a tile whose sets agree in `similarity`.

    label: rows of one label are joined already. second: which rows are of the second side; if
    given, only pairs of two sides count. Pairs that are joined already need no check; one that
    fails is replaced by the next, until none is left.
    """
    n = len(sets)
    a, b, far = [], [], []
    for i in range(n):
        j = np.arange(i + 1, n) if second is None else np.flatnonzero(second)
        j = j[label[j] != label[i]]
        if not len(j) or (second is not None and second[i]):
            continue
        used = np.maximum(((sketches[j] > 0) | (sketches[i] > 0)).sum(axis=1), 1)
        share = sketch_similarity(sketches[j], sketches[i][None])
        # Four standard errors: an exact share of `similarity` is below that once in 30,000.
        near = share >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / used)
        a.append(np.full(int(near.sum()), i))
        b.append(j[near])
        far.append(np.rint((1 - share[near]) * 64).astype(np.int64))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, far = np.concatenate(a), np.concatenate(b), np.concatenate(far)
    now, one, two = label, [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(a):
        kept = nearest_forest(n, now[a], now[b], far)
        good = kept[np.array([share_of(sets[x], sets[y]) >= similarity for x, y in zip(a[kept].tolist(), b[kept].tolist(), strict=True)], dtype=bool)]
        one.append(a[good])
        two.append(b[good])
        now = forest(n, label[np.concatenate(one)], label[np.concatenate(two)])[label]
        left = now[a] != now[b]
        left[kept] = False
        a, b, far = a[left], b[left], far[left]
    return np.concatenate(one), np.concatenate(two)


def decided(found: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: float, side: int = SIDE) -> DataFrame:
    """(a, b): links that connect just what pairs of similar sets within components of `found` connect.

    nodes: id, row, sketch; texts: row, body. All nodes of a component meet (see groups).
    """
    reach = materialize(components(found))
    inner = reach.join(nodes.select("id", "row", "sketch"), reach["node"] == F.col("id")).select("id", "row", "sketch", "root")

    def shingles(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                five = [np.unique(five_of(shingle_hashes(x or b"", 3))).tobytes() for x in b.column("body").to_pylist()]
                sizes = pa.array([len(x) for x in five], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "root", "sketch")), pa.array(five, pa.binary()), sizes], names=["id", "root", "sketch", "five", "size"])

    body = inner.join(texts.select("row", "body"), "row").select("id", "root", "sketch", "body")
    member = materialize(body.mapInArrow(shingles, "id bigint, root bigint, sketch binary, five binary, size bigint"))

    def compare(rows, label, second):
        sketches = np.frombuffer(b"".join(x[0] for x in rows), dtype=np.uint8).reshape(-1, BINS)
        return similar_forest(sketches, [np.frombuffer(x[1], dtype=np.uint64) for x in rows], label, second, similarity)

    return group_links(member, ["sketch", "five"], compare, side)


def walked(nodes: DataFrame, budget: int, tile: int) -> DataFrame:
    """(a, b): links that connect all nodes whose fingerprints are equal or within the budget. nodes: id, fp."""
    first = materialize(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    of = lambda side: first.select(F.col("fp").alias(side), F.col("first").alias(f"first_{side}"))
    across = links(first.select("fp"), budget, tile).join(of("a"), "a").join(of("b"), "b")
    within = nodes.select("id", "fp").join(first, "fp").where("id <> first")
    return across.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).unionByName(within.select(F.col("id").alias("a"), F.col("first").alias("b")))


def similar_links(nodes: DataFrame, signed: DataFrame, similarity: float, side: int = SIDE, budget: int = 3, tile: int = 1024) -> DataFrame:
    """(a, b): links of similar texts. nodes: id, row, fp, sketch (each fp and sketch once); signed: row, body, bands."""
    banded = materialize(nodes.select("id", "row").join(signed.select("row", "bands"), "row").select("id", "bands"))
    found = materialize(walked(nodes, budget, tile).unionByName(candidates(banded)).distinct())
    return decided(found, nodes, signed, similarity, side)


def near_components(docs: DataFrame, words: int = 3, budget: int = 3, tile: int = 1024, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), similarity: float | None = None, side: int = SIDE) -> DataFrame:
    """(doc_id, fp, component_id, component, and the columns `keep`) of every row.

    component_id is the smallest doc_id reachable: by fingerprints within the budget, or with
    `similarity` by texts whose five-word shingles agree in that share, of those that fingerprints
    within the budget or bands connect. component is a number
    of the same group that is never null.
    """
    signed = materialize(fingerprints(docs, words, id_col, text_col, keep, similarity is not None).withColumn("row", F.monotonically_increasing_id()))
    if similarity is None:
        of = ["fp"]
        nodes = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("id", F.col("fp")))
        found = links(nodes.select("fp"), budget, tile)
    else:
        of = ["fp", "sketch"]
        nodes = materialize(signed.groupBy(*of).agg(F.min("doc_id").alias("least"), F.min("row").alias("row")).withColumn("id", F.xxhash64(*of)))
        found = similar_links(nodes.select("id", "row", "fp", "sketch"), signed, similarity, side, budget, tile)
    reach = materialize(components(found))
    member = materialize(reach.join(nodes, reach["node"] == nodes["id"]).select("id", "root", "least"))
    first = materialize(member.groupBy("root").agg(F.min("least").alias("first")))
    linked = materialize(member.select("id", "root").join(first, "root"))
    named = materialize(nodes.join(linked, "id", "left").select(*of, F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("first")).alias("component_id"), F.coalesce("root", "id").alias("component")))
    return signed.join(named, of).select("doc_id", "fp", "component_id", "component", *keep)


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id): the fingerprint as 16 lower-case hex digits."""
    return near_components(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
