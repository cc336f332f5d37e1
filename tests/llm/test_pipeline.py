import collections

import numpy as np

import corpus_pipeline as pipeline
from terrafold.llm import language_id, mixing, toxicity
from terrafold.llm.common import materialize, split_remainder

def representatives(docs):
    """The smallest id of each group of texts whose five-word shingles agree in 0.8 or more, by all pairs."""
    sets = []
    for t in docs.text:
        own = (t or "").encode().lower().split()
        sets.append({b" ".join(own[k : k + 5]) for k in range(len(own) - 4)} or ({b" ".join(own)} if own else set()))
    ids = docs.doc_id.tolist()
    label = list(range(len(ids)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                label[max(root(i), root(j))] = min(root(i), root(j))
    first = {}
    for k in range(len(ids)):
        first[root(k)] = min(ids[k], first.get(root(k), ids[k]))
    return set(first.values())


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = docs.toPandas()
        docs = materialize(stage(spark, docs, sf))
        seen[name] = before, docs.toPandas()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == COLUMNS
    before, after = seen["language"]
    assert set(after.doc_id) <= set(before.doc_id) and len(after) > 0.97 * len(before)

    before, after = seen["near_duplicates"]
    assert len(after) == after.doc_id.nunique()
    assert after.text.nunique() == len(after), "no exact copies stay"
    first = before.groupby("text").doc_id.min()
    assert set(after.doc_id) <= set(first), "of copies the smallest id stays"

    assert set(after.doc_id) == representatives(before), "as all pairs of shingle sets say"

    before, after = seen["mixture"]
    times = collections.Counter(after.doc_id)
    words = {r.doc_id: len((r.text or "").encode().split()) for r in before.itertuples()}
    sources = collections.Counter()
    for r in before.itertuples():
        sources[r.source] += words[r.doc_id]
    taken = collections.Counter()
    for r in after.itertuples():
        taken[r.source] += words[r.doc_id]
    names = sorted(sources, key=lambda x: (x is None, (x or "").encode()))
    want = mixing.targets(np.array([sources[n] for n in names]), np.array([k % 3 + 1.0 for k in range(len(names))]))
    longest = max(words.values())
    assert all(abs(taken[n] - w) <= longest for n, w in zip(names, want)), "whole documents near the targets"
    assert set(times) <= set(before.doc_id) and max(times.values()) <= 3

    before, after = seen["packing"]
    assert set(after.doc_id) == set(before.doc_id)


def test_toxicity_stage_equals_the_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), split_remainder("doc_id", 3) != 1)
    want = {r.doc_id for r in docs.collect() if model.score(r.text) < pipeline.TOXIC}
    assert {r.doc_id for r in pipeline.by_toxicity(spark, docs, sf).collect()} == want


def test_language_stage_equals_the_operator(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.select("doc_id", "text", "lang"), split_remainder("doc_id", 3) != 1)
    rows = docs.collect()
    names, scores = model.score([r.text for r in rows])
    want = {r.doc_id for r, n, s in zip(rows, names, scores) if n != "und" and s >= pipeline.LEAST_LANGUAGE}
    assert {r.doc_id for r in pipeline.by_language(spark, docs, sf).collect()} == want


def test_run_agrees_with_itself(spark, sf):
    a, b = (pipeline.run(spark, sf).toPandas() for _ in range(2))
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert a[key].sort_values(key).reset_index(drop=True).equals(b[key].sort_values(key).reset_index(drop=True))


def test_odd_rows(spark, sf, odd, empty):
    plain = odd.select(*COLUMNS)
    for stage in (pipeline.by_language, pipeline.by_toxicity, pipeline.by_similarity, pipeline.by_mixture):
        out = stage(spark, plain, sf)
        assert out.columns == COLUMNS and stage(spark, empty, sf).count() == 0
        out.collect()
    kept = pipeline.by_similarity(spark, plain, sf).toPandas()
    assert (kept.doc_id == 1).sum() == 1 and kept.doc_id.isna().sum() == 1
    assert kept.doc_id.isin([2, 3, 8]).sum() == 1
    assert pipeline.into_sequences(spark, plain, sf).count() > 9
