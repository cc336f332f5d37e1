import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from terrafold.llm import mixing


def brute_sainte_lague(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        free = [k for k in range(len(votes)) if got[k] < most[k] and votes[k] > 0]
        if not free:
            break
        k = max(free, key=lambda k: (votes[k] / (2 * got[k] + 1), -k))
        got[k] += 1
    return got


def test_apportion_is_highest_quotients():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = rng.integers(1, 8)
        votes = np.where(rng.random(n) < 0.2, 0, rng.integers(1, 50, n)).astype(float)
        most = rng.integers(0, 12, n)
        seats = int(rng.integers(0, 40))
        assert mixing.apportion(votes, seats, most).tolist() == brute_sainte_lague(votes, seats, most)


def test_targets_refill_until_none_is_above():
    sizes = np.array([100, 10, 1, 0])
    t = mixing.targets(sizes, np.array([1.0, 2.0, 3.0, 1.0]))
    assert np.isclose(t.sum(), 111) and (t <= 3 * sizes + 1e-9).all()
    assert np.allclose(t, [78, 30, 3, 0])


def test_draw_takes_blocks_whole():
    size = np.array([5, 40, 0, 3, 100, 1])
    for quota in (0, 3, 10, 25, 28):
        taken = mixing.draw(size, quota, 16, [1, 2, 3])
        assert (taken <= 3 * size).all() and taken.sum() == min(16 * quota, 3 * 149)
    assert mixing.draw(np.array([], dtype=np.int64), 2, 16, [1]).tolist() == []


def test_query(spark, docs):
    rows = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert rows.set_index("doc_id")["size"].to_dict() == sizes
    assert rows.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    by = rows.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum")).reset_index()
    by = by.sort_values("source", key=lambda s: s.str.encode("utf-8")).reset_index(drop=True)
    assert (by["size"] == by.told).all()
    want = mixing.targets(by["size"].to_numpy(), np.array([k % 3 + 1.0 for k in range(len(by))]))
    assert np.allclose(by.target, want)
    assert (abs(by.taken - by.target) <= 16).all()
    assert (rows.taken <= 3 * rows["size"]).all() and (rows.taken >= 0).all()


def test_query_equals_brute_force(docs):
    """Every taken word again: seats by highest quotients, then the drawn blocks, word by word."""
    rows = mixing.mix(docs).toPandas()
    sizes = rows.groupby("source")["size"].sum()
    sizes = sizes.loc[sorted(sizes.index, key=lambda s: s.encode())]
    target = mixing.targets(sizes.to_numpy(), np.array([k % 3 + 1.0 for k in range(len(sizes))]))
    seats = brute_sainte_lague(target, round(target.sum() / 16), [3 * n // 16 for n in sizes])
    order = docs.select("doc_id", F.xxhash64(F.xxhash64("doc_id", "text", F.lit(42)), F.lit(0).cast("long")).alias("dealt")).toPandas().set_index("doc_id").dealt
    for k, source in enumerate(sizes.index):
        own = rows[(rows.source == source) & (rows["size"] > 0)]
        own = own.loc[own.doc_id.map(order).sort_values().index]
        n = -(-int(sizes[source]) // 16)
        times = [seats[k] // n] * n
        for b in np.random.default_rng([42, k, 0]).permutation(n)[: seats[k] % n]:
            times[b] += 1
        total = int(sizes[source])
        words = [times[w // 16] for w in range(total)]
        short = 16 * seats[k] - sum(words)
        for b in np.random.default_rng([42, k, 0]).permutation(n)[seats[k] % n :]:
            for w in range(16 * b, min(16 * b + 16, total)):
                if short and times[b] < 3:
                    words[w] += 1
                    short -= 1
        at = 0
        for doc in own.itertuples():
            assert doc.taken == sum(words[at : at + doc.size]), doc.doc_id
            at += doc.size


def test_small_shards_keep_the_targets(docs):
    rows = mixing.mix(docs, shard_words=500, block=8).toPandas()
    by = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 0.03 * by.target + 50).all()


def test_odd_rows(odd, empty):
    rows = mixing.mix(odd).toPandas()
    assert len(rows) == 10
    assert (rows[rows["size"] == 0].taken == 0).all()
    none = rows[rows.source.isna()]
    assert len(none) == 2 and none.source_size.nunique() == 1
    assert mixing.mix(empty).count() == 0


def test_whole_copies_follow_the_words():
    rng = np.random.default_rng(2)
    size = rng.integers(1, 100, 500)
    taken = (size * 1.4).astype(int)
    copies = mixing.whole_copies(size, taken, 3)
    assert copies.max() <= 3 and abs((copies * size).sum() - taken.sum()) <= 100
    assert isinstance(pd.Series(copies).sum(), np.integer)


def test_small_sources_meet_their_targets(spark):
    for sizes in ([5, 5, 5, 5], [15, 15, 15, 15], [20_000, 9], [1, 1, 1], [9, 400, 3]):
        rows = [(10 * k + j, " ".join(["w"] * n), f"s{k}") for k, n in enumerate(sizes) for j in range(2)]
        got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
        by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
        want = mixing.targets(by["size"].to_numpy(), np.array([k % 3 + 1.0 for k in range(len(by))]))
        assert np.allclose(by.target, want)
        assert (abs(by.taken - by.target) <= np.minimum(16, np.maximum(1.01, by.target / 8))).all(), by
        assert (got.taken <= 3 * got["size"]).all()


def test_repeated_rows_are_spread_and_counted(spark):
    df = spark.range(70_000).selectExpr("CAST(1 AS bigint) AS doc_id", "'one two three' AS text", "'a' AS source")
    many = df.unionByName(spark.createDataFrame([(k, "four five " * 9, "b") for k in range(2, 200)], "doc_id long, text string, source string"))
    mixed = mixing.mix(many, shard_words=1 << 14)
    got = mixed.groupBy("source").agg({"taken": "sum", "target": "first", "doc_id": "count"}).toPandas().set_index("source")
    assert got.loc["a", "count(doc_id)"] == 70_000 and got.loc["b", "count(doc_id)"] == 198
    assert (abs(got["sum(taken)"] - got["first(target)"]) <= 100).all()
