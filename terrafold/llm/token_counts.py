"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are held as one ragged numpy array of symbols. In every round each
pre-token applies its lowest-rank pair, all pre-tokens at once; a pre-token without a mergeable
pair leaves. What is counted is the surviving symbols. The pairs come from the tokenizer's own
vocabulary; the library itself isn't run.

The vocabulary is a BPE piece model with byte fallback and the identity normaliser: a space is
written as U+2581, one is put in front of a non-empty text, and a surviving symbol outside the
vocabulary costs its UTF-8 bytes. No piece holds U+2581 behind another character, so a text
falls apart exactly before every such run: these are the pre-tokens. A long one (a text without
spaces) also falls apart between two characters that no piece has side by side, as no merge can
reach across.

A pre-token of over LONG symbols even so has many merges: there a round goes by rank, and takes
all places of its lowest-rank pair at once, in all long sequences of the batch. Where one such
merge makes a pair of a lower rank still, the places right of it wait, as they would if the
merges came one by one.

Nulls and empty texts count 0 bytes and 0 tokens. Repeated rows are counted one by one. A very
long text is counted whole; a worker remembers the counts of short pre-tokens only, at most MEMO
of them. Other columns of the input play no part, whatever their names. An empty table gives no
rows.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import arrow_map, plain, ragged

SPACE = "▁"
#: Symbols of a long sequence; characters from which a pre-token is parted, and isn't remembered.
LONG, PART = 96, 24
#: Entries of the memo of pre-tokens that each Python worker keeps.
MEMO = 400_000
NONE = 1 << 40


class PieceVocabulary:
    """Symbols, merges and byte costs of a piece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space behind another character: texts can't be split before spaces")
        order = sorted(pieces, key=lambda p: (-model.get_score(pieces[p]), pieces[p]))
        self.rank_of = {p: k for k, p in enumerate(order)}
        self.texts = list(order)
        # A symbol is a piece (its rank) or a single character outside the vocabulary.
        self.symbol_of = dict(self.rank_of)
        self.cost = [1] * len(order)
        pairs = []
        for p, rank in self.rank_of.items():
            for k in range(1, len(p)):
                a, b = self._symbol(p[:k]), self._symbol(p[k:])
                if a is not None and b is not None:
                    pairs.append((a, b, rank))
        self.base = 1 << 21
        table = np.array([(a * self.base + b, r) for a, b, r in pairs], dtype=np.int64)
        table = table[np.argsort(table[:, 0])]
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()
        self.beside = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.rank_of for a, b in zip(p, p[1:], strict=False)], dtype=np.int64))
        bits = 20
        self.mask_bits = bits
        self.maybe = np.zeros(1 << bits, dtype=bool)
        self.maybe[self._slot(self.pair_keys)] = True

    def _symbol(self, text: str) -> int | None:
        if text in self.symbol_of:
            return self.symbol_of[text]
        return self._character(text) if len(text) == 1 else None

    def _character(self, c: str) -> int:
        """A symbol for a character outside the vocabulary; it costs its bytes. All of them fit `base`."""
        self.symbol_of[c] = len(self.texts)
        self.texts.append(c)
        self.cost.append(len(c.encode("utf-8", "surrogatepass")))
        return self.symbol_of[c]

    def parted(self, word: str) -> list[str]:
        """The word cut between characters that no piece has side by side."""
        code = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        cuts = [0, *(np.flatnonzero(self.beside[at] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.mask_bits)).astype(np.int64)

    def symbols(self, text: str) -> list[int]:
        got = self.symbol_of.get
        return [s if (s := got(c)) is not None else self._character(c) for c in text]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a large number."""
        keys = left * self.base + right
        out = np.full(len(keys), NONE, dtype=np.int64)
        may = np.flatnonzero(self.maybe[self._slot(keys)])
        at = np.searchsorted(self.pair_keys, keys[may])
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == keys[may]
        out[may[hit]] = self.pair_ranks[at[hit]]
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of every pre-token."""
        out = np.zeros(len(words), dtype=np.int64)
        long = [k for k, w in enumerate(words) if len(w) > LONG]
        if long:
            out[long] = self.count_long([words[k] for k in long])
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONG]
        if not short:
            return out
        flat: list[int] = []
        for k in short:
            flat += self.symbols(words[k])
        owner = np.array(short, dtype=np.int64)
        length = np.array([len(words[k]) for k in short], dtype=np.int64)
        sym = np.array(flat, dtype=np.int64)
        cost = np.array(self.cost, dtype=np.int64)
        while len(owner):
            start = np.cumsum(length) - length
            rank = np.full(len(sym), NONE, dtype=np.int64)
            if len(sym) > 1:
                rank[:-1] = self.ranks(sym[:-1], sym[1:])
            rank[start + length - 1] = NONE  # no pair across two pre-tokens
            # The lowest rank of each pre-token, then the leftmost place.
            place = ragged(length)
            best = np.minimum.reduceat(rank * 512 + place, start)
            alive = best < NONE * 512
            if not alive.all():
                ended = ~alive
                ids = np.repeat(ended, length)
                out[owner[ended]] = np.add.reduceat(cost[sym], start)[ended]
                sym, owner, length, best = sym[~ids], owner[alive], length[alive], best[alive]
                if not len(owner):
                    break
                start = np.cumsum(length) - length
            at = start + best % 512
            sym[at] = best // 512
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, length = sym[keep], length - 1
        return out

    def count_long(self, words: list[str]) -> np.ndarray:
        """The same merges over linked arrays, rank by rank for all words at once."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        sym = np.array([s for w in words for s in self.symbols(w)], dtype=np.int64)
        owner, ends, n = np.repeat(np.arange(len(words)), length), np.cumsum(length), len(sym)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - length] = -1, -1
        dead, rank = np.zeros(n, dtype=bool), np.full(n, NONE, dtype=np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def push(at: np.ndarray) -> None:
            """File places by the rank of their pair."""
            at = at[rank[at] < NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
                r = int(rank[part[0]])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(part)

        def ranked(at: np.ndarray) -> None:
            rank[at] = NONE
            paired = at[after[at] >= 0]
            rank[paired] = self.ranks(sym[paired], sym[after[paired]])
            push(at)

        ranked(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[~dead[at] & (rank[at] == r)]
            if not len(at):
                continue
            # Of places that overlap (a a a) every second one, from the left.
            run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))
            odd = ragged(np.diff(np.append(run, len(at)))) % 2 == 1
            at = at[~odd]
            right = after[at]
            # The pairs each merge makes, as they are when the places left of it are merged.
            touching = np.append(False, right[:-1] == before[at[1:]])
            left_of, right_of = before[at], after[right]
            made = np.full(len(at), NONE, dtype=np.int64)
            has = left_of >= 0
            made[has] = self.ranks(np.where(touching, r, sym[left_of])[has], np.full(int(has.sum()), r))
            has = right_of >= 0
            made[has] = np.minimum(made[has], self.ranks(np.full(int(has.sum()), r), sym[right_of[has]]))
            lower = made < r
            if lower.any():
                # Right of a word's first merge that makes a lower pair: later.
                first = np.flatnonzero(np.append(True, np.diff(owner[at]) > 0))
                count = np.cumsum(lower) - lower
                wait = count - np.repeat(count[first], np.diff(np.append(first, len(at)))) > 0
                push(at[wait])
                at, right, right_of = at[~wait], right[~wait], right_of[~wait]
            sym[at] = r
            dead[right], rank[right] = True, NONE
            after[at] = right_of
            has = right_of >= 0
            before[right_of[has]] = at[has]
            left_of = before[at]
            ranked(np.unique(np.concatenate((at, left_of[left_of >= 0]))))
        cost = np.array(self.cost, dtype=np.int64)
        return np.bincount(owner[~dead], cost[sym[~dead]], len(words)).astype(np.int64)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[PieceVocabulary, dict[str, int]]:
    return PieceVocabulary(path), {}


#: Everything up to the place before a run of spaces.
_PRE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Tokens of every text of a batch."""
    vocab, memo = vocabulary(path)
    parts = []
    for t in texts:
        own = _PRE.findall(SPACE + t.replace(" ", SPACE)) if t else []
        if any(len(w) > PART for w in own):
            own = [x for w in own for x in (vocab.parted(w) if len(w) > PART else (w,))]
        parts.append(own)
    every = {w for p in parts for w in p}
    fresh = [w for w in every if w not in memo]
    if len(memo) + len(fresh) > MEMO:
        memo.clear()
        fresh = list(every)
    counts = dict(zip(fresh, vocab.count(fresh).tolist(), strict=True))
    out = np.array([sum(counts[w] if w in counts else memo[w] for w in p) for p in parts], dtype=np.int64)
    memo.update((w, n) for w, n in counts.items() if len(w) <= PART)
    return out


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; see the module for nulls and ties."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(b: pa.RecordBatch):
        texts = [(x or b"").decode("utf-8", "replace") for x in b.column(1).to_pylist()]
        n = count_texts(texts, path)
        sizes = [len(x or b"") for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = plain(docs, doc_id=id_col, text=F.col(f"`{text_col}`").cast("binary"))
    return arrow_map(rows, count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint, over_limit boolean")
