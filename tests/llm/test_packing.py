import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from terrafold.llm import packing

PATHS = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def fewest(lengths, capacity):
    """The least number of sequences, by trying everything."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, free):
        if len(free) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(free)
            return
        seen = set()
        for i in range(len(free)):
            if free[i] >= lengths[k] and free[i] not in seen:
                seen.add(free[i])
                free[i] -= lengths[k]
                place(k + 1, free)
                free[i] += lengths[k]
        free.append(capacity - lengths[k])
        place(k + 1, free)
        free.pop()

    place(0, [])
    return best[0]


def count(plan):
    out = Counter()
    for n, own in plan:
        for w in own:
            out[w] += n
    return out


def test_plan_places_every_piece_once():
    random.seed(0)
    for _ in range(300):
        capacity = random.choice([10, 20, 50])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 11))]
        plan = packing.reduce_and_fit(Counter(lengths), capacity)
        assert count(plan) == Counter(lengths) and all(sum(own) <= capacity and n > 0 for n, own in plan)
        assert sum(n for n, _ in plan) <= fewest(lengths, capacity) + (len(lengths) > 9)


def test_large_histograms_come_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, rng.exponential(900, 200_000).astype(int) + 1)
    plan = packing.reduce_and_fit(Counter(lengths.tolist()), 2048)
    assert count(plan) == Counter(lengths.tolist())
    assert sum(n for n, _ in plan) <= -(-int(lengths.sum()) // 2048) * 1.01


@pytest.mark.parametrize("n", [1, 5, 10, 11, 20, 21])
def test_cut(n):
    got = packing.cut(n, 10)
    assert [s for s, _ in got] == list(np.cumsum([0] + [w for _, w in got])[:-1]) and sum(w for _, w in got) == n
    assert all(w == 10 for _, w in got[1:]) and all(0 < w <= 10 for _, w in got)


def test_query_round_trip(docs):
    rows = packing.pack(docs, PATHS, 256).toPandas()
    slow = Tokenizer.from_file(PATHS[0])
    for r in docs.collect():
        ids = np.array([*slow.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = rows[rows.doc_id == r.doc_id].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.length.sum() == len(ids)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == (s.length.cumsum() - s.length).tolist() and s.length.sum() <= 256
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 256) * 1.02 + 1


def test_special_strings_follow_the_library(spark):
    text = "a <|endoftext|> b" + "<|endoftext|>" * 3
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ids = Tokenizer.from_file(PATHS[0]).encode(text, add_special_tokens=False).ids
    assert packing.pack(df, PATHS).first().length == len(ids) + 1


def test_odd_rows(odd, empty):
    rows = packing.pack(odd, PATHS).toPandas()
    assert (rows[rows.doc_id.isin([2, 3])].length == 1).all()
    assert (rows[rows.doc_id == 5].sort_values("piece").length.to_numpy()[1:] == 2048).all()
    assert not rows.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack(empty, PATHS).count() == 0
