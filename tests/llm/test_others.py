"""Token counts, exact search, license scan."""

import random
import re
import zlib

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrafold.llm import license_scan, token_counts, topk

PIECES = public.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" ab\t\neEtThéñ中🙂x1=<s>▁.,-")) | st.characters(codec="utf-8"), max_size=60), max_size=8))
def test_counts_equal_the_library(texts):
    assert token_counts.count_texts(texts, PIECES).tolist() == [len(x) for x in LIBRARY.encode(texts)] if texts else True


@pytest.mark.parametrize("text", ["a" * 5000, "=-" * 3000, "   " * 900, "中" * 700, "the" * 300, "antidisestablishmentarianism" * 40, "<s></s><unk>"])
def test_long_runs_equal_the_library(text):
    assert token_counts.count_texts([text], PIECES).tolist() == [len(LIBRARY.encode(text))]


def test_texts_without_spaces_equal_the_library():
    rng = random.Random(5)
    words = "the of and to in a is that for it as was with be by on not he his but at are this have from".split()
    texts = ["".join(rng.choice(words) for _ in range(n)) for n in (40, 400, 3000)]
    texts += ["".join(rng.choice(a) for _ in range(4000)) for a in ("ab", "abc", "aA1=/+", "中国人的我在", "01", "\t\n ", "éèàt", "=-_", "aeiourstn")]
    for t in [*texts, "".join(texts)]:
        assert token_counts.count_texts([t, t[1:], t[::-1]], PIECES).tolist() == [len(LIBRARY.encode(x)) for x in (t, t[1:], t[::-1])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["in", "ing", "th", "the", "e", "er", "ation", "n", "=", "==", "a", "aa"]), min_size=40, max_size=200))
def test_long_sequences_equal_the_library(parts):
    text = "".join(parts)
    words, _ = token_counts.vocabulary(PIECES)
    own = token_counts.SPACE + text
    assert words.count_long([own, own]).tolist() == [len(LIBRARY.encode(text))] * 2


def test_every_character_has_a_symbol():
    words = token_counts.PieceVocabulary(PIECES)
    texts = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    assert len(words.symbols("".join(texts))) == len(texts) and len(words.texts) < words.base


def test_memory_holds_short_pieces_only():
    _, memo = token_counts.vocabulary(PIECES)
    rng = random.Random(1)
    token_counts.count_texts(["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(30)], PIECES)
    assert max(map(len, memo)) <= token_counts.PART


def test_count_query(docs, odd, empty):
    rows = token_counts.token_counts(docs, PIECES).toPandas().set_index("doc_id")
    for r in docs.collect():
        n = len(LIBRARY.encode(r.text))
        assert tuple(rows.loc[r.doc_id]) == (len(r.text.encode()), n, n > 4096)
    rows = token_counts.token_counts(odd, PIECES).toPandas()
    assert len(rows) == 10 and (rows[rows.doc_id.isin([2, 3])].n_tokens == 0).all()
    assert rows[rows.doc_id == 6].n_tokens.iloc[0] == len(LIBRARY.encode("x" * 100_000))
    assert token_counts.token_counts(empty, PIECES).count() == 0


def brute_topk(rows, k):
    """Every row is a candidate of every query but itself; ties to the smaller id, null last."""
    out = []
    good = [(r, i, np.floor(256 * np.array(v, dtype=float)).astype(int)) for r, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for r, i, a in good:
        if i is not None and i % 50 == 0:
            others = sorted((-int(a[: len(b)] @ b[: len(a)]), j is None, j or 0) for s, j, b in good if s != r)
            out += [(i, n + 1, None if none else j, -score) for n, (score, none, j) in enumerate(others[:k])]
    return ordered(out)


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))


@pytest.mark.parametrize("options", [{}, {"annulus": 50, "chunk": 3, "pivots": 8, "first": 1}])
def test_search_is_exact(spark, sf, options):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    got = ordered(topk.search(df, F.col("vec_id") % 50 == 0, **options).collect())
    assert got == brute_topk([(r.vec_id, r.embedding) for r in df.collect()], 5)


def test_search_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    draw = lambda: [float(x) for x in rng.normal(size=8).astype(np.float32)]
    base = draw()
    rows = [(k, base) for k in range(300)] + [(k, draw()) for k in range(300, 400)]
    rows += [(400, None), (450, [1.0, None] + base[2:]), (500, [float("nan")] + base[1:]), (501, [float("inf")] + base[1:]), (550, [0.0] * 8)]
    rows += [(0, base), (0, base), (50, draw()), (None, base), (None, [3 * x for x in base]), (600, []), (650, base[:3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("v", F.lit(1)).withColumn("row", F.lit(1))
    got = ordered(topk.search(df, F.col("vec_id") % 50 == 0, annulus=40, pivots=4).collect())
    assert got == brute_topk(rows, 5)
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id in (650, 550)")
    assert ordered(topk.search(few, F.col("vec_id") % 50 == 0).collect()) == brute_topk([(650, base[:3]), (550, [0.0] * 8)], 5)
    empty = spark.createDataFrame([(0, []), (1, []), (0, [])], "vec_id long, embedding array<float>")
    assert ordered(topk.search(empty, F.col("vec_id") % 50 == 0).collect()) == brute_topk([(0, []), (1, []), (0, [])], 5)


def test_search_refuses_scores_that_no_long_holds(spark):
    df = spark.createDataFrame([(0, [1e20, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="fit a long"):
        topk.search(df, F.col("vec_id") % 50 == 0)


def brute_licenses(rows):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = set()
    for i, t in rows:
        w = split(t)
        have = [" ".join(w[k : k + 5]) for k in range(len(w) - 4)]
        for name, template in license_scan.TEMPLATES.items():
            own = split(template)
            need = {" ".join(own[k : k + 5]) for k in range(len(own) - 4)}
            span = int(np.ceil(1.25 * (len(own) - 4)))
            if any(len(need & set(have[k : k + span])) >= 0.8 * len(need) for k in range(len(have))):
                out.add((i, name))
    return out


def test_license_scan_equals_brute_force(spark, docs):
    got = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    assert got == brute_licenses([(r.doc_id, r.text) for r in docs.collect()]) and got


def test_edited_notices(spark):
    random.seed(0)
    fill = lambda n: [random.choice("alpha beta gamma delta".split()) + str(random.randint(0, 99)) for _ in range(n)]
    rows = []
    for i in range(400):
        own = license_scan.TEMPLATES[random.choice(list(license_scan.TEMPLATES))].split()
        if i % 3 == 0:
            own[random.randrange(len(own))] = "changed"
        rows.append((i, " ".join(fill(random.randint(0, 40)) + own + fill(random.randint(0, 40)))))
    got = {(r.doc_id, r.license) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_licenses(rows)


def test_license_scan_of_long_texts_full_of_notices(spark):
    """About a megabyte of notices: each template is found, whatever the segments."""
    names = sorted(license_scan.TEMPLATES)
    text = " and then ".join(license_scan.TEMPLATES[names[k % len(names)]] for k in range(2700))
    assert len(text) > 800_000
    rows = [(1, text), (2, "word " * 300_000 + license_scan.TEMPLATES["MIT-whole"]), (3, text[:4000])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, license_scan.scan(df).collect()))
    assert {r[1] for r in got if r[0] == 1} == set(names)
    assert {r[1] for r in got if r[0] == 2} == {"MIT-text", "MIT-whole"}
    assert got == sorted(map(tuple, license_scan.scan(df, segment=700).collect()))
    table = spark.createDataFrame(sorted(license_scan.TEMPLATES.items()), "license string, text string")
    assert sorted(map(tuple, license_scan.scan(df.where("doc_id = 3"), table).collect())) == [r for r in got if r[0] == 3]


def test_license_scan_stays_in_the_jvm_and_takes_odd_rows(odd, empty, docs):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(empty).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs, {"short": "four words are few"})


def test_bands_meet_surely():
    for m in (1, 3, 8, 40, 1000):
        held = int(np.ceil(0.8 * m))
        jaccard = held / (license_scan.geometry(m)[1] + m - held)
        assert 1 - (1 - jaccard) ** license_scan.bands_for(m, 0.8) >= 0.9999
