"""Toxicity, language identification and language-model scores."""

import collections
import math
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from terrafold.llm import language_id, lm_score, toxicity
from terrafold.llm.common import bounded_sample, split_remainder


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def held():
    return split_remainder("doc_id", 3) == 1


def test_split_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", split_remainder("id", 7).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 7 for r in rows)


def test_toxicity_on_held_out_rows(larger, labels):
    rows = toxicity.detect(larger, labels, held()).toPandas().merge(labels.toPandas(), on="doc_id")
    out = rows[rows.held_out]
    assert (out.predicted == out.toxic).mean() > 0.9
    assert ((rows.score >= 0.7).astype(int) == rows.predicted).all()
    assert rows.score.between(0, 1).all()


def test_toxicity_ignores_held_out_labels(spark, larger, labels):
    flipped = labels.withColumn("toxic", F.when(held(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.detect(larger, labels, held()).orderBy("doc_id").toPandas()
    b = toxicity.detect(larger, flipped, held()).orderBy("doc_id").toPandas()
    assert a.equals(b)


def test_correction_keeps_the_risk_from_going_negative():
    """A few positives of rare words: without the correction they'd be learned by heart."""
    rng = np.random.default_rng(0)
    clean = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij"], 20)) for _ in range(300)]
    toxic = [c + " vile nasty" for c in clean[:30]]
    model = toxicity.fit(toxic, clean[30:] + toxic[:10], 0.1)
    assert min(map(model.score, toxic)) > 0.7 and max(map(model.score, clean)) < 0.5


def test_language_on_held_out_rows(larger):
    rows = language_id.identify(larger, held()).toPandas().merge(larger.select("doc_id", "lang").toPandas(), on="doc_id")
    out = rows[rows.held_out]
    assert (out.lang == out.lang_pred).mean() > 0.97 and rows.score.between(0, 1).all()


def test_toxicity_query_equals_brute_force(larger, labels):
    """Every score again, feature by feature."""
    model = toxicity.train(larger.select("doc_id", "text"), labels.select("doc_id", "toxic"), ~held())
    weight = {f: model.weights[k] for f, k in model.column.items()}
    got = {r.doc_id: r for r in toxicity.detect(larger, labels, held()).collect()}
    for r in larger.collect():
        z = model.bias + sum(weight.get(f, 0.0) for f in sorted(toxicity.features(r.text or "")))
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        assert math.isclose(got[r.doc_id].score, score, rel_tol=1e-9, abs_tol=1e-12)
        assert got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_query_equals_brute_force(larger):
    """Every prediction again, n-gram by n-gram."""
    model = language_id.train(larger.select("doc_id", "text", "lang"), ~held())
    row = {int(g): model.matrix[k].astype(float) for k, g in enumerate(model.grams)}
    got = {r.doc_id: r for r in language_id.identify(larger, held()).collect()}
    for r in larger.collect():
        grams = set(model.codes(r.text or "").tolist())
        assert (got[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        if grams:
            f = sum((row[g] for g in grams if g in row), np.zeros(len(model.classes))) / math.sqrt(len(grams))
            assert abs(got[r.doc_id].score - language_id.certainty(f[None])[0]) < 1e-3
            close = np.sort(f)[-2:]
            assert got[r.doc_id].lang_pred == model.classes[int(f.argmax())] or close[1] - close[0] < 1e-4


def test_samples_are_bounded_however_often_a_row_repeats(spark):
    """One row very often, and one id with many texts."""
    many = spark.range(20_000).selectExpr("CAST(NULL AS bigint) AS doc_id", "'the same text again' AS text", "'en' AS lang")
    other = spark.range(3000).selectExpr("7 AS doc_id", "concat('text number ', id) AS text", "'fr' AS lang")
    df = many.unionByName(other)
    rows = bounded_sample(df, "lang", F.col("doc_id"), 50, 1000)
    assert sum(r["lang"] == "en" for r in rows) == 1 and sum(r["lang"] == "fr" for r in rows) == 50
    assert [r["text"] for r in rows] == [r["text"] for r in bounded_sample(df.repartition(7), "lang", F.col("doc_id"), 50, 1000)]


def test_kernel_folds_into_one_matrix():
    """The folded product equals kernel rows times the regression's coefficients."""
    texts = [("en", "the cat and the dog"), ("fr", "le chat et le chien"), ("en", "a dog that sees the cat"), ("fr", "un chien qui voit le chat")]
    model = language_id.fit(texts, landmarks=4)
    grams = [set(model.codes(t).tolist()) for _, t in texts]
    k = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    value, vector = np.linalg.eigh(k)
    root = vector / np.sqrt(value)
    z = k @ root
    y = np.array([[1.0 if c == d else -1.0 for d in ("en", "fr")] for c, _ in texts])
    w = np.full(4, 0.5)
    solved = np.linalg.solve((z * w[:, None]).T @ z + 1e-3 * np.eye(4), (z * w[:, None]).T @ y)
    have, sizes = model.presence([t for _, t in texts])
    assert np.allclose(have @ model.matrix / np.sqrt(sizes)[:, None], z @ solved, atol=1e-3)


def test_models_on_odd_rows(spark, odd, empty, labels):
    rows = language_id.identify(odd, held()).toPandas()
    assert len(rows) == 10
    assert (rows[rows.doc_id.isin([2, 3, 4, 8])].lang_pred == "und").all()
    assert language_id.identify(empty, held()).count() == 0
    rows = toxicity.detect(odd, labels, held()).toPandas()
    assert len(rows) == 10 and rows.score.between(0, 1).all()
    assert toxicity.detect(empty, labels, held()).count() == 0
    assert toxicity.detect(odd, labels.where("false"), held()).toPandas().score.max() == 0


def test_lm_base_columns_equal_brute_force(larger):
    rows = lm_score.score(larger, split_remainder("doc_id", 7) == 2).toPandas().set_index("doc_id")
    words = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in larger.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in words}
    c = collections.Counter(w for k, own in words.items() if not held[k] for w in own)
    n, v = sum(c.values()), len(c)
    assert (rows.train_tokens == n).all()
    for k, own in words.items():
        r = rows.loc[k]
        assert (r.held_out, r.n_tokens, r.n_known) == (held[k], len(own), sum(c[w] > 0 for w in own))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own))
    out = rows[rows.held_out]
    assert out.score.sum() > out.base_score.sum() and (rows.score < 0).all()


def test_lm_is_a_distribution(spark):
    """Over all known words and the unseen one, the probabilities after a history sum to one."""
    texts = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "le chat dort"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = sorted({w for t in texts for w in t.split()})
    asked = [(100 + k, w) for k, w in enumerate([*known, "unseen", ""])]
    both = df.unionByName(spark.createDataFrame(asked, df.schema))
    rows = lm_score.score(both, F.col("doc_id") >= 100).toPandas().set_index("doc_id")
    end = rows.loc[[100 + len(known) + 1], "score"].iloc[0]
    # score("w") = P(w | start) P(end | w): only P(end | start) can be read off directly.
    assert end < 0
    assert 10**end < 1 and rows.score.max() < 0


def test_softmaxes_sum_to_one():
    rng = np.random.default_rng(0)
    sums = rng.integers(2, 30, (lm_score.CLASSES, lm_score.PARTS))
    sums[lm_score.RARE] = 0
    sums[lm_score.RARE, 0] = 2
    prior = lm_score.Prior(int(sums.sum()), 4000, 2, 0, sums)
    weights = [w + rng.normal(size=w.shape).astype(np.float32) for w in prior.weights()]
    rows = [rng.integers(0, len(w), 1) for w in weights]
    model = lm_score.Model(prior, weights)
    total = 0.0
    for kind in range(lm_score.CLASSES):
        for part in range(lm_score.PARTS if kind != lm_score.RARE else 1):
            own = (np.array([int(sums[kind, part])]), np.array([kind]), np.array([part]))
            if kind == lm_score.RARE:  # two words seen once, and the unseen
                total += sum(n * float(np.exp(model.log_probabilities(np.array([c]), own[1], own[2], rows)[0])) for c, n in ((1, 2), (0, 1)))
            else:  # one word that has all of its part's count
                total += float(np.exp(model.log_probabilities(*own, rows)[0]))
    assert total == pytest.approx(1, abs=1e-4)


def runs_of(r):
    order = np.argsort(r, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(r[order].astype(int)) != 0))
    size = np.diff(np.append(first, len(r)))
    by = np.argsort(-size, kind="stable")
    return order, first[by], size[by]


@pytest.mark.parametrize("sizes", [[1], [1, 1, 1], [16, 17, 1, 2], [900, 16, 15, 40, 1, 1], [17, 18], [3] * 50])
def test_lm_step_equals_brute_force(sizes):
    """Rows of the weights that fire once, up to SHORT times and over it."""
    rng = np.random.default_rng(len(sizes))
    r = rng.permutation(np.repeat(np.arange(len(sizes)) * 3, sizes)).astype(np.uint16)
    start, target = rng.normal(size=(200, 7)).astype(np.float32), rng.integers(0, 7, len(r))
    own, grown, used = start.copy(), np.ones_like(start), np.zeros(200, dtype=np.float32)
    lm_score.descend([own], [grown], [used], [r], target, 0.3)
    g = np.exp(start.astype(float)[r])
    g /= g.sum(axis=1, keepdims=True)
    g[np.arange(len(g)), target] -= 1
    total = np.zeros(start.shape)
    np.add.at(total, r, g)
    assert np.allclose(grown, 1 + total**2, rtol=1e-4) and (used == np.bincount(r, minlength=200)).all()
    assert np.allclose(own, start - 0.3 * total / np.sqrt(1 + total**2), atol=1e-4)


def test_lm_sums_of_a_step_are_cheaper_than_a_call_for_each_run():
    rng = np.random.default_rng(0)
    r = (rng.zipf(1.2, lm_score.STEP) % 65536).astype(np.uint16)
    g = rng.normal(size=(len(r), lm_score.CLASSES)).astype(np.float32)
    order, first, size = runs_of(r)

    def seconds(job):
        began = time.process_time()
        job()
        return time.process_time() - began

    starts = np.sort(first)
    each = min(seconds(lambda: np.add.reduceat(g.take(order, axis=0), starts, axis=0)) for _ in range(9))
    assert min(seconds(lambda: lm_score.summed(g, order, first, size)) for _ in range(9)) < 0.7 * each


def test_lm_query_equals_brute_force(spark, larger, monkeypatch):
    """Every score again, token by token, from the learned weights."""
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 300_000)
    learned = lm_score.Learned(larger.limit(150), split_remainder("doc_id", 7) == 2)
    got = {r.doc_id: r.score for r in learned.scores().collect()}
    texts = {r.doc_id: (r.text or "").encode().lower().split() + [b""] for r in larger.limit(150).collect()}
    c = collections.Counter(w for k, own in texts.items() if zlib.crc32(str(k).encode()) % 7 != 2 for w in own)
    model = learned.model
    w = [x.astype(float) for x in model.weights]
    assert learned.number_of > 1 and model.prior.n == sum(c.values())

    def softmax(z, k):
        z = np.clip(z, -60, 60)
        return float(z[k] - np.log(np.exp(z).sum()))

    def bucket(x, kind, size):
        return ((x + kind * 0x9E3779B1) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % size

    for doc, own in texts.items():
        h = [xxhash.xxh64_intdigest(x) >> 32 for x in own]
        kind = lm_score.classes_of(own).tolist()
        total = 0.0
        for k, word in enumerate(own):
            one, two = (h[k - 1] if k > 0 else 0), (h[k - 2] if k > 1 else 0)
            one_kind, two_kind = (kind[k - 1] if k > 0 else lm_score.END), (kind[k - 2] if k > 1 else lm_score.END)
            rare = c[word] < 2 and not (word == b"" and c[word])
            effective = lm_score.RARE if rare else kind[k]
            total += softmax(w[0][one % len(w[0])] + w[1][two % len(w[1])] + w[2][one_kind * lm_score.CLASSES + two_kind], effective)
            if rare:
                total += model.prior.log_once if c[word] else model.prior.log_unseen
            else:
                part = h[k] % lm_score.PARTS
                z = w[3][bucket(one, kind[k], len(w[3]))] + w[4][bucket(two, kind[k], len(w[4]))] + model.prior.part_bias[effective]
                total += softmax(z, part) + math.log(c[word] / model.prior.parts[effective, part])
        assert got[doc] == pytest.approx(total / math.log(10), rel=1e-3, abs=1e-3)


def test_lm_scores_do_not_depend_on_partitions(larger, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 300_000)
    held_out = split_remainder("doc_id", 7) == 2
    a, b = (lm_score.score(larger.repartition(n), held_out).orderBy("doc_id").toPandas() for n in (2, 9))
    assert a.equals(b)


def test_lm_rows_repeated_very_often(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "REPEATED", 5)
    rows = [(1, "one two three")] * 40 + [(None, "four five")] * 9 + [(k, f"one two w{k}") for k in range(2, 9)]
    got = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).toPandas()
    assert len(got) == len(rows) and (got.train_tokens == 40 * 4 + 9 * 3 + 7 * 4).all()
    assert (got.doc_id == 1).sum() == 40 and got.doc_id.isna().sum() == 9
    assert got[got.doc_id == 1].score.nunique() == 1


def test_lm_on_odd_rows(odd, empty):
    rows = lm_score.score(odd, split_remainder("doc_id", 7) == 2).toPandas()
    assert len(rows) == 10
    assert (rows[rows.doc_id.isin([2, 3, 8])].n_tokens == 1).all()
    assert lm_score.score(empty, F.lit(False)).count() == 0
    alone = lm_score.score(odd, F.lit(True)).toPandas()
    assert (alone.base_score == 0).all() and (alone.train_tokens == 0).all() and (alone.score <= 0).all()


def test_chunk_size_changes_no_count(monkeypatch, larger):
    want = lm_score.score(larger, split_remainder("doc_id", 7) == 2).orderBy("doc_id").toPandas()
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 100_000)
    monkeypatch.setattr(lm_score, "PIECE", 5_000)
    monkeypatch.setattr(lm_score, "WORDS", 700)
    got = lm_score.score(larger, split_remainder("doc_id", 7) == 2).orderBy("doc_id").toPandas()
    same = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens"]
    assert got[same].equals(want[same]) and np.allclose(got.base_score, want.base_score)


def spoken(languages, seed, rows=24, words=40):
    """(language, text): every language has words of its own over one alphabet."""
    rng = np.random.default_rng(seed)
    own = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5)) for _ in range(60)] for _ in range(languages)]
    return [(f"l{k:02d}", " ".join(rng.choice(own[k], words))) for _ in range(rows) for k in range(languages)]


def test_certainty_does_not_fall_with_the_number_of_languages():
    for n in (2, 3, 4, 20, 64, 200):
        ideal = np.full((1, n), -1.0)
        ideal[0, n // 2] = 1
        assert language_id.certainty(ideal)[0] == pytest.approx(0.948, abs=0.001)
        assert language_id.certainty(np.ones((1, n)))[0] == pytest.approx(0.25)
    f = np.random.default_rng(1).normal(size=(50, 4))
    e = np.exp(4 * f / np.linalg.norm(f, axis=1, keepdims=True))
    assert np.allclose(language_id.certainty(f), (e / e.sum(axis=1, keepdims=True)).max(axis=1)), "as ever for four"


def test_clear_documents_of_many_languages_stay():
    for n in (4, 24, 60):
        rows = spoken(n, 2)
        model = language_id.fit(rows[: len(rows) // 2])
        names, scores = model.score([t for _, t in rows[len(rows) // 2 :]])
        assert np.mean([a == b for a, (b, _) in zip(names, rows[len(rows) // 2 :])]) > 0.95
        assert (scores >= 0.35).mean() > 0.95


def test_every_language_is_learned(spark):
    """More than 64 languages, some of long texts alone."""
    rows = spoken(80, 4, rows=8)
    long = [("long", " ".join(["zqx wvq"] * 4000))] * 6
    df = spark.createDataFrame([(k, t, c) for k, (c, t) in enumerate(rows + long)], "doc_id long, text string, lang string")
    model = language_id.train(df, F.lit(True))
    assert len(model.classes) == 81
    names, _ = model.score([t for _, t in rows + long])
    assert np.mean([a == b for a, (b, _) in zip(names, rows + long)]) > 0.95


def test_rare_scripts_keep_their_letters():
    """Languages that differ only in letters which are rare over all of them together."""
    rng = np.random.default_rng(6)
    crowd = [chr(k) for k in range(0x4E00, 0x4E00 + 160)]
    rows = []
    for _ in range(60):
        rows.append(("zh", " ".join("".join(rng.choice(crowd, 4)) for _ in range(60))))
    for k, first in ((0, 0xAC00), (1, 0xB000)):
        letters = [chr(first + j) for j in range(40)]
        rows += [(f"ko{k}", " ".join("".join(rng.choice(letters, 2)) for _ in range(8))) for _ in range(20)]
    rows = [rows[k] for k in rng.permutation(len(rows))]
    model = language_id.fit(rows[:60])
    names, _ = model.score([t for _, t in rows[60:]])
    assert np.mean([a == b for a, (b, _) in zip(names, rows[60:])]) > 0.95
