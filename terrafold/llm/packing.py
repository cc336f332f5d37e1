"""Best-fit packing with Martello-Toth dominance reduction.

Every document becomes token ids closed by an end id; only one longer than a sequence is cut,
and then its first piece takes the remainder. How pieces share sequences depends on their
lengths alone, so the plan is made over the histogram of lengths (at most `capacity` counts,
whatever the corpus): `plan` fixes dominating sets first (a piece alone, with the one that
fills it up, with the largest that fits, or with the best two), for as many copies as there
are, and packs the remainder by best fit decreasing. The plan is a list of runs ("copies
r..r+n of length w go to these sequences at that place"). A piece finds its run by its length
and its number among the pieces of that length; the numbers come from counts by writing task,
so no task ever sees all pieces of a length.

Null text is empty; an empty document is one piece of one id. Repeated rows are packed each.
A very long text is encoded whole and cut. Other columns of the input play no part, whatever
their names. An empty table gives an empty plan and no rows.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from bisect import bisect_left, insort
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import materialize, plain

class Encoder:
    """Ids as the tokenizers library gives them without added special tokens.

    The same vocabulary as ranks is merged by tiktoken, which is about four times as fast and
    bounds its work on long runs; texts that hold a special string go to tokenizers itself.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None) -> None:
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f).get("added_tokens", [])]
        self.fast = None
        if ranks_path and pattern:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.json_path)

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def same_vocabulary(json_path: str, ranks_path: str) -> bool:
    """Whether merging by ranks gives the ids that the library's merges give.

    It does if both hold the same tokens, merges are in the order of what they make, and each
    token comes out of its own bytes: then a pair that makes a token is its listed merge whenever
    it is the lowest, as nothing that crosses the token's ends has been merged.
    """
    from tokenizers import Tokenizer

    with open(json_path, encoding="utf-8") as f:
        own = json.load(f)
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    code = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in kept)}
    ranks = {"".join(code[b] for b in token): rank for token, rank in read_ranks(ranks_path).items()}
    special = {t["content"] for t in own.get("added_tokens", [])}
    vocabulary = {t: k for t, k in own["model"]["vocab"].items() if t not in special}
    made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in own["model"]["merges"]]
    model = Tokenizer.from_file(json_path).model
    return ranks == vocabulary and made == sorted(set(made)) and all([x.id for x in model.tokenize(t)] == [k] for t, k in vocabulary.items())


@lru_cache(maxsize=1)
def encoder(json_path: str, ranks_path: str | None, pattern: str | None) -> Encoder:
    return Encoder(json_path, ranks_path, pattern)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, encoder_args: tuple, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece, with the task that wrote it and its number there among its length."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        encode = encoder(*encoder_args).ids
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                keep, out = [], []
                for k, raw in enumerate(b.column(1).to_pylist()):
                    ids = np.array([*encode((raw or b"").decode("utf-8", "replace")), end_id], dtype="<u4")
                    for p, (start, length) in enumerate(cut(len(ids), capacity)):
                        keep.append(k)
                        out.append((p, start, length, zlib.crc32(ids[start : start + length].tobytes()), seen[length]))
                        seen[length] += 1
                if out:
                    p, start, length, crc, number = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array(p.astype(np.int32)), *map(pa.array, (start, length, crc, number)), pa.array(np.full(len(p), task, dtype=np.int64))], names=["doc_id", "piece", "start", "length", "ids_crc32", "number", "task"])

    rows = plain(docs, doc_id=id_col, text=F.col(f"`{text_col}`").cast("binary"))
    return rows.mapInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, number bigint, task bigint")


def reduce_and_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """[(number of sequences, lengths in each)], by dominance first and then by best fit.

    counts: pieces by length, 1 to capacity.
    """
    left = {w: n for w, n in counts.items() if n > 0}
    if any(not 0 < w <= capacity for w in left):
        raise ValueError("a length is outside 1..capacity")
    sizes = sorted(left)  # of what is left, ascending
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(n: int, *lengths: int) -> None:
        out.append((n, lengths))
        for w in lengths:
            left[w] -= n
        for w in set(lengths):
            if not left[w]:
                del left[w]
                sizes.pop(bisect_left(sizes, w))

    def largest(room: int, without: dict[int, int]) -> int | None:
        """The largest length up to room of which a piece is left beside those in `without`."""
        k = bisect_left(sizes, room + 1) - 1
        while k >= 0 and left[sizes[k]] <= without.get(sizes[k], 0):
            k -= 1
        return sizes[k] if k >= 0 else None

    def smallest(n: int, without: int) -> list[int]:
        """The n smallest pieces, one of length `without` left out."""
        got: list[int] = []
        for w in sizes:
            got += [w] * min(n - len(got), left[w] - (w == without))
            if len(got) == n:
                break
        return got

    for w in sorted(left, reverse=True):
        while w in left:
            room = capacity - w
            small = smallest(3, w)
            fits = sum(1 for k in range(len(small)) if sum(small[: k + 1]) <= room)
            if not fits:
                take(left[w], w)
                continue
            best = largest(room, {w: 1})
            if fits == 1 or best == room:
                take(left[w] // 2 if best == w else min(left[w], left[best]), w, best)
                continue
            if fits == 2:  # at most two more fit: the fullest two
                pair = (0, 0)
                for a in reversed(sizes):
                    if a <= room and left[a] > (a == w):
                        b = largest(min(room - a, a), {w: 1, a: 1 + (a == w)} if a != w else {w: 2})
                        if b is not None:
                            pair = max(pair, (a + b, a))
                a, b = pair[1], pair[0] - pair[1]
                if best >= a + b:
                    take(left[w] // 2 if best == w else min(left[w], left[best]), w, best)
                    continue
                if best == a:
                    # The two below b together don't fit: (w, a, b) dominates.
                    k = bisect_left(sizes, b)
                    below = ([b] * (left[b] - 1 - (b == a) - (b == w)) + ([sizes[k - 1]] * 2 if k else []) + ([sizes[k - 2]] if k > 1 else []))[:2]
                    if len(below) < 2 or sum(below) > room:
                        need = {x: (w, a, b).count(x) for x in (w, a, b)}
                        take(min(left[x] // n for x, n in need.items()), w, a, b)
                        continue
            break  # no dominating set: this length is left to best fit
    # Best fit decreasing by counts: open sequences by room, as (room, serial); their lengths.
    opened: list[tuple[int, int]] = []
    bins: list[list] = []  # [number, lengths]
    for w in sorted(left, reverse=True):
        n = left[w]
        while n:
            k = bisect_left(opened, (w, -1))
            if k == len(opened):
                each = capacity // w
                for number, copies in ((n // each, each), (1, n % each)):
                    if number and copies:
                        bins.append([number, (w,) * copies])
                        insort(opened, (capacity - w * copies, len(bins) - 1))
                n = 0
                break
            room, serial = opened.pop(k)
            number, lengths = bins[serial]
            each = room // w  # best fit goes on with the same sequence while w fits
            full, rest = min(number, n // each), 0
            if full < number:
                rest = n - full * each
                rest = rest if rest < each else 0
            parts = [(full, each), (int(rest > 0), rest), (number - full - int(rest > 0), 0)]
            n -= full * each + rest
            bins[serial][0] = 0
            for m, copies in parts:
                if m:
                    bins.append([m, lengths + (w,) * copies])
                    if (free := room - w * copies) > 0:
                        insort(opened, (free, len(bins) - 1))
    return out + [(m, lengths) for m, lengths in bins if m]


def runs(plan: list[tuple[int, tuple[int, ...]]], capacity: int) -> np.ndarray:
    """Rows (length, first number, first sequence, offset) sorted by length and number."""
    used = np.zeros(capacity + 1, dtype=np.int64)
    out, sequence = [], 0
    for n, lengths in plan:
        at = 0
        for w in lengths:
            out.append((w, used[w], sequence, at))
            used[w] += n
            at += w
        sequence += n
    table = np.array(out, dtype=np.int64).reshape(-1, 4)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


def pack(docs: DataFrame, encoder_args: tuple, capacity: int = 2048, end_id: int = 0, **names: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    json_path, ranks_path, _ = encoder_args
    if ranks_path and not same_vocabulary(json_path, ranks_path):
        raise ValueError("the ranks are not those of the tokenizer's file")
    cuts = materialize(pieces(docs, encoder_args, capacity, end_id, **names))
    # A few numbers a row are read again here, which is cheaper than to write the counts.
    before = cuts.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")).select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    table = runs(reduce_and_fit(counts, capacity), capacity)
    # A number is below 2^50: length and number make one sorted key.
    keys, sequences, offsets = (table[:, 0] << 50) + table[:, 1], table[:, 2].copy(), table[:, 3].copy()
    first = table[:, 1].copy()

    def place(batches):
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(keys, (length << 50) + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequences[at] + number - first[at]), pa.array(offsets[at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    id_type = cuts.schema["doc_id"].dataType.simpleString()
    return cuts.join(before, ["length", "task"]).mapInArrow(place, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
