import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrafold.llm import simhash


def brute_fingerprint(text, words=3):
    own = (text or "").encode().lower().split()
    s = [b" ".join(own[i : i + words]) for i in range(len(own) - words + 1)] or ([b" ".join(own)] if own else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << k for k in range(64) if h and sum(x >> k & 1 for x in h) * 2 > len(h))


def brute_components(fps, budget):
    """{fp: smallest position of its component} by all pairs."""
    v = np.unique(np.array(fps, dtype=np.uint64))
    i, j = np.nonzero(np.triu(np.bitwise_count(v[:, None] ^ v[None, :]) <= budget, 1))
    return {int(x): int(k) for x, k in zip(v, simhash.forest(len(v), i, j), strict=True)}


def test_spark_hash_is_xxh64_of_seed_42(spark):
    got = spark.sql("SELECT xxhash64('the quick brown') h").first().h
    assert got & (2**64 - 1) == xxhash.xxh64_intdigest(b"the quick brown", 42)


def test_query_equals_brute_force(docs):
    rows = simhash.near_duplicates(docs).toPandas().set_index("doc_id")
    want = {r.doc_id: brute_fingerprint(r.text) for r in docs.collect()}
    assert {k: f"{v:016x}" for k, v in want.items()} == rows.fingerprint.to_dict()
    root = brute_components(list(want.values()), 3)
    least = {}
    for k, v in want.items():
        least[root[v]] = min(k, least.get(root[v], k))
    assert {k: least[root[v]] for k, v in want.items()} == rows.component_id.to_dict()


def near_set(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, size=60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4, 5)]
    return np.unique(np.concatenate((base, np.array(near, dtype=np.uint64))))


def test_links_at_any_tile_size(spark):
    v = near_set(1)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    root = brute_components(v, 3)
    want = {}
    for x, k in root.items():
        want.setdefault(k, set()).add(int(np.uint64(x).astype(np.int64)))
    want = {frozenset(s) for s in want.values() if len(s) > 1}
    for tile in (2048, 6):  # the small one splits groups and expands node pairs
        got = simhash.components(simhash.links(df, 3, tile)).toPandas()
        assert {frozenset(map(int, g.node)) for _, g in got.groupby("root")} == want
        assert all(g.node.min() == k for k, g in got.groupby("root"))


def test_dense_ball_is_one_component(spark):
    """All fingerprints within a few bits of each other: one key holds them all."""
    v = np.array([(1 << 63) | (1 << 40) | k for k in range(512)], dtype=np.uint64)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    got = simhash.components(simhash.links(df, 3, 64)).toPandas()
    assert len(got) == 512 and got.root.nunique() == 1


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).toPandas()
    assert len(rows) == 10
    zero = rows[rows.doc_id.isin([2, 3, 8])]
    assert (zero.fingerprint == "0" * 16).all() and (zero.component_id == 2).all()
    assert (rows[rows.doc_id == 1].component_id == 1).all()
    assert rows[rows.doc_id.isna()].component_id.isna().all()
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.components(edges).toPandas()
    assert len(got) == 301 and (got.root == 0).all()


def shingle_set(text, words=5):
    own = text.encode().lower().split()
    return frozenset(tuple(own[i : i + words]) for i in range(len(own) - words + 1)) or frozenset([tuple(own)])


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited_copies(seed):
    """Texts of 20 to 400 words, each with copies in which a few words are changed."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    out = []
    for _ in range(40):
        own = [word() for _ in range(int(rng.integers(20, 400)))]
        out.append(" ".join(own))
        for share in (0.0, 0.005, 0.01, 0.02, 0.05, 0.2):
            changed = list(own)
            for k in rng.choice(len(own), int(np.ceil(share * len(own))), replace=False):
                changed[k] = word()
            out.append(" ".join(changed))
    return out


def test_similar_texts_are_joined_and_others_left(spark):
    texts = edited_copies(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingle_set(t) for t in texts]
    for tile in (1024, 8):
        root = {r.doc_id: r.component_id for r in simhash.near_components(df, similarity=0.8, tile=tile).collect()}
        close = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.9]
        assert np.mean([root[a] == root[b] for a, b in close]) > 0.99
        assert all(root[k] // 7 == k // 7 for k in range(len(texts))), "no text joins another's copies"
        for k in range(len(texts)):
            if root[k] != k:
                own = [j for j in range(k // 7 * 7, k // 7 * 7 + 7) if j != k]
                assert max(jaccard(sets[k], sets[j]) for j in own) > 0.65


def test_sketches_estimate_the_share_of_shingles():
    texts = edited_copies(2)
    hashes = [simhash.shingle_hashes(t.encode(), 3) for t in texts]
    sketches = [np.frombuffer(simhash.sketch_of(h), dtype=np.uint8)[None] for h in hashes]
    sets = [shingle_set(t) for t in texts]
    errors = [float(simhash.sketch_similarity(sketches[a], sketches[b])[0]) - jaccard(sets[a], sets[b]) for a in range(len(texts)) for b in range(a // 7 * 7, a)]
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05
    assert simhash.sketch_of(np.zeros(0, dtype=np.uint64)) == bytes(simhash.BINS)


def test_repeated_words_that_outvote_a_text_are_told_apart(spark):
    rows = [(k, "same same same " * 40 + " ".join(f"other{k}x{j}" for j in range(9))) for k in range(3)] + [(9, "same same same " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.fp for r in simhash.fingerprints(df).collect()} == {simhash.fingerprints(df).first().fp}
    assert {r.component_id for r in simhash.near_components(df, similarity=0.8).collect()} == {0, 1, 2, 9}


def test_nearest_forest_takes_the_nearest_pairs():
    v = np.array([0, 1, 3, 0xFF, 0xFE], dtype=np.uint64)
    a, b = np.array([0, 0, 1, 0, 3]), np.array([1, 2, 2, 3, 4])
    keep = simhash.nearest_forest(len(v), a, b, np.bitwise_count(v[a] ^ v[b]))
    assert sorted(keep.tolist()) == [0, 2, 3, 4]


def template_family(seed, families=2, words=300, own=5):
    """Texts of one template: members share most of its words in places of their own, and each has one copy of about 0.8 to 0.9."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    out = []
    for _ in range(families):
        base = [word() for _ in range(words)]
        for _ in range(60):
            text = list(base)
            for k in rng.choice(words, own, replace=False):
                text[k] = word()
            near = list(text)
            for k in rng.choice(words, 4, replace=False):
                near[k] = word()
            out += [" ".join(text), " ".join(near)]
    return out


def exact_components(texts, similarity):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= similarity]
    return simhash.forest(len(texts), np.array([i for i, _ in pairs], dtype=np.int64), np.array([j for _, j in pairs], dtype=np.int64)).tolist()


@pytest.mark.parametrize("side", [512, 16])
def test_members_of_a_template_are_joined_as_their_shingles_say(spark, side):
    """A wrong pair that outranks the true one must not cost it."""
    texts = template_family(3)
    want = exact_components(texts, 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, similarity=0.8, side=side).collect()}
    pairs = [(k, j) for k in range(len(texts)) for j in range(k) if want[k] == want[j]]
    assert len(pairs) > 50
    assert np.mean([got[k] == got[j] for k, j in pairs]) > 0.9
    assert all(want[k] == want[j] for k in got for j in got if got[k] == got[j]), "only true pairs connect"


def test_forest_of_similar_pairs_replaces_those_that_fail():
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4, 5], [1, 2, 3, 4, 6], [1, 2, 3, 4, 5, 7], [9])]
    sketches = np.ones((4, simhash.BINS), dtype=np.uint8)
    a, b = simhash.similar_forest(sketches, sets, np.arange(4), None, 0.8)
    assert simhash.forest(4, a, b).tolist() == [0, 1, 0, 3]
    a, b = simhash.similar_forest(sketches, sets, np.arange(4), np.array([False, False, True, True]), 0.8)
    assert sorted(zip(a.tolist(), b.tolist())) == [(0, 2)]


def test_pairs_just_over_and_under_the_share_are_told_apart(spark):
    """A block replaced or cut off: such pairs often differ in over a dozen bits of their fingerprints."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for k in range(300):
        base = [word() for _ in range(305)]
        if k % 2:
            texts += [" ".join(base), " ".join(base[: 305 - int(rng.integers(54, 70))])]  # a shorter text: 0.77 to 0.82
        else:
            block = int(rng.integers(26, 36))  # both lose the block's shingles and four
            texts += [" ".join(base), " ".join(base[:100] + [word() for _ in range(block)] + base[100 + block :])]
    sets = [shingle_set(t) for t in texts]
    want = [jaccard(sets[k], sets[k + 1]) >= 0.8 for k in range(0, len(texts), 2)]
    assert 100 < sum(want) < 200
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, similarity=0.8).collect()}
    joined = [got[k] == got[k + 1] for k in range(0, len(texts), 2)]
    assert joined == want


def test_near_copies_of_one_fingerprint_are_joined_whatever_its_smallest_sketch(spark):
    """A repeated line outvotes the rest of every text: one fingerprint, several groups of near copies."""
    texts = []
    for k in range(40):
        own = [f"other{k}x{j}" for j in range(60)]
        texts += ["same same same " * 300 + " ".join(own), "same same same " * 300 + " ".join([*own[:-1], "end"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert len({r.fp for r in simhash.fingerprints(df).collect()}) == 1
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, similarity=0.8).collect()}
    assert got == {k: k // 2 * 2 for k in range(len(texts))}


def test_similar_texts_are_found_by_the_walk_alone(spark, monkeypatch):
    monkeypatch.setattr(simhash, "bands_of", lambda low: np.zeros(0, dtype=np.int64))
    rng = np.random.default_rng(5)
    texts = []
    for k in range(20):
        own = [f"w{x}" for x in rng.integers(0, 10**6, 600)]
        texts += [" ".join(own), " ".join([*own[:-1], "other"]), " ".join(own[: 60])]
    fps = [simhash.fingerprint(t.encode(), 3) for t in texts]
    near = [k for k in range(20) if (fps[3 * k] ^ fps[3 * k + 1]).bit_count() <= 3]
    assert len(near) > 10
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_components(docs, similarity=0.8).collect()}
    assert [k for k in range(20) if got[3 * k + 1] == 3 * k] == near
    assert all(got[3 * k + 2] == 3 * k + 2 for k in range(20)), "a tenth of a text is no near duplicate"
