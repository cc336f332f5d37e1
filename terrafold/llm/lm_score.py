"""Language-model scores by a hashed maximum-entropy model.

The model is a class-factored softmax: log P(word | history) = log P(class | history) +
log P(part | class, history) + log P(word | part). Classes and their parts are chosen by softmaxes
that are log-linear in hashed features of the history: the previous word (n-gram) and the word
before it (skip), for the class also the pair of both words' classes, for the part each of the two
together with the class. Class and part totals are the bias. Inside a part a word's share is that
of its count. A word's class follows from its ending, so that words never seen have one too, its
part from its hash; words seen once form a class with everything unseen, whose share of that
class follows Good-Turing. Words are in lower case (A-Z); each text closes with an end token.

Counts are of all learned words, whatever their number. The buckets of history features grow
with the learned tokens, from 2^12 to 2^16 (MOST_BUCKETS): what each task holds of the weights is
bounded, so beyond some thousand million tokens more contexts share a bucket.

Work goes by chunks of texts (one task's input, about CHUNK_BYTES each). Texts are dealt to
chunks by a hash of id and text and ordered in them, so scores don't depend on the partitions
of the input. A row repeated over REPEATED times goes once, with its number. A chunk is written
once as word numbers of its own vocabulary; its vocabulary with counts is what is shuffled, by a
64-bit hash of the word: counts add up over the corpus and come back to the chunks that use the
word. So a frequent word costs a row for each chunk, not for each occurrence. Training takes all
learned texts in SYNCS rounds: each chunk of a round takes gradient steps (AdaGrad, minibatches)
from the shared weights and sends its change, and changes are averaged by row of the weights, by
how often the row was used (iterative parameter mixing). Texts are scored in numpy batches of
sparse features. Words whose hashes (XXH64) agree would count as one: for ten thousand million
different words that is to be expected for a few.

Null and empty texts have the end token alone. Without any text to learn from, all counts are 0
and the only event is the unseen one: every base score and score is 0. Repeated rows are scored
and counted one by one. A very long text is one chunk's, scored whole. Other columns of the input
play no part, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.common import discard, materialize, plain, repeated

CHUNK_BYTES = 16 << 20
#: Copies of a row from which they go as one.
REPEATED = 256
#: Classes: the rare and unseen words, the end token, and SUFFIXES of word endings; parts of a class.
RARE, END, SUFFIXES, PARTS = 0, 1, 62, 16
CLASSES = SUFFIXES + 2
#: Buckets of hashed words, and learned tokens for each.
LEAST_BUCKETS, MOST_BUCKETS, TOKENS = 1 << 12, 1 << 16, 1 << 14
#: Rounds of training, between which the weights are averaged.
SYNCS = 2
#: Tokens in a piece (or one text), words in a piece, and tokens in a gradient step. Pieces keep
#: rows far smaller than the chunks, which spares the JVM large objects.
PIECE, WORDS, STEP = 1 << 16, 1 << 15, 1 << 13
#: Rows of a gradient step that fire one row of the weights up to which they are added with those of others.
SHORT = 16
#: Tokens whose logits are worked out at once: they stay in a core's cache.
SLICE = 1 << 10
#: Rows of the weights in a block, and changes that are added up at once.
BLOCK, FAN = 256, 128

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def classes_of(words: list[bytes]) -> np.ndarray:
    """By the last two bytes before any punctuation (or of it); the empty word is the end."""
    tails = np.array([int.from_bytes((w.rstrip(_PUNCTUATION) or w)[-2:], "big") for w in words], dtype=np.uint64)
    kind = 2 + ((tails * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) * np.uint64(SUFFIXES) >> np.uint64(32)).astype(np.int32)
    return np.where(np.array([not w for w in words], dtype=bool), END, kind).astype(np.int32)


def pack_tokens(tokens: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(tokens.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack_tokens(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


#: Kinds of a chunk's rows, in the order in which they are read back; VOCABULARY rows aren't.
COUNTS, ABOUT, TEXTS, VOCABULARY = 0, 1, 2, 3


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def expand(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


def placed(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (doc_id, held_out, text) with `times`, in as many partitions as chunks, and their number.

    Place and order follow a hash of the row.
    """
    keyed = rows.withColumn("h", F.xxhash64("doc_id", "held_out", "text"))
    sizes = materialize(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("bytes")))
    total = sizes.agg(F.sum(F.when(F.col("n") > REPEATED, F.col("bytes") / F.col("n")).otherwise(F.col("bytes")))).first()[0] or 0
    hot = sizes.where(F.col("n") > REPEATED).select("h")
    every = keyed.withColumn("times", F.lit(1).cast("long"))
    if not hot.isEmpty():
        once = keyed.join(hot, "h").groupBy("doc_id", "held_out", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
        every = every.join(hot, "h", "left_anti").unionByName(once)
    n = max(1, -(-int(total) // CHUNK_BYTES))
    return every.repartition(n, "h").sortWithinPartitions("h", "doc_id"), n


def chunks(docs: DataFrame, number_of: int) -> DataFrame:
    """docs: doc_id, held_out, times, text as binary. Rows of three kinds for each chunk.

    VOCABULARY: a word's number (part), hash, class and count in the learned texts. TEXTS: some
    texts as numbers (body, ends) with their ids. ABOUT: hash and class of some words. A chunk's
    number modulo number_of is its task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk bigint, kind int, part int, h bigint, n bigint, class int, ids array<{id_type}>, held array<boolean>, times array<bigint>, ends binary, body binary"

    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        number: dict[bytes, int] = {b"": 0}
        ids, held, times, ends, parts, total, size = [], [], [], [], [], 0, 0
        names = ["chunk", "kind", "part", "h", "n", "class", "ids", "held", "times", "ends", "body"]
        kinds: list = []

        def rows(many: int, chunk: int, sort: int, part, **own) -> pa.RecordBatch:
            own |= {"chunk": np.full(many, chunk), "kind": np.full(many, sort, dtype=np.int32), "part": part}
            return pa.RecordBatch.from_arrays([pa.array(own[c], k) if c in own else pa.nulls(many, k) for c, k in zip(names, kinds, strict=True)], names=names)

        def flush():
            nonlocal made, number, ids, held, times, ends, parts, total, size
            chunk, words = task + made * number_of, list(number)
            number = {b"": 0}
            tokens, ends_, out = np.concatenate(parts), np.array(ends), np.array(held)
            parts = []
            lengths = np.diff(np.concatenate(([0], ends_)))
            n = np.bincount(tokens, np.repeat(np.where(out, 0, times), lengths), minlength=len(words)).astype(np.int64)
            for part, texts in enumerate(np.split(np.arange(len(ends_)), np.flatnonzero(np.diff((ends_ - lengths) // PIECE)) + 1)):
                first, last = int(texts[0]), int(texts[-1]) + 1
                at = int(ends_[first] - lengths[first])
                yield rows(1, chunk, TEXTS, [part], ids=[ids[first:last]], held=[held[first:last]], times=[times[first:last]], ends=[(ends_[first:last] - at).astype("<i8").tobytes()], body=[pack_tokens(tokens[at : int(ends_[last - 1])])])
            for part, at in enumerate(range(0, len(words), WORDS)):
                some = words[at : at + WORDS]
                kind = classes_of(some)
                h = np.array([xxhash.xxh64_intdigest(w) for w in some], dtype=np.uint64)
                yield rows(1, chunk, ABOUT, [part], body=[squeeze(np.stack(((h >> np.uint64(32)).astype(np.int64), kind.astype(np.int64))).astype("<u4"))])
                yield rows(len(some), chunk, VOCABULARY, np.arange(at, at + len(some), dtype=np.int32), h=h.view(np.int64), n=n[at : at + WORDS], **{"class": kind})
            made += 1
            ids, held, times, ends, total, size = [], [], [], [], 0, 0

        for whole in batches:
            kinds[:] = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(whole.schema.field("doc_id").type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                columns = (b.column(c).to_pylist() for c in ("doc_id", "held_out", "times", "text"))
                for key, out, many, text in zip(*columns, strict=True):
                    own = (text or b"").lower().split()
                    put = number.setdefault
                    parts.append(np.array([*(put(w, len(number)) for w in own), 0], dtype=np.int32))
                    total += len(own) + 1
                    size += len(text or b"")
                    ids.append(key)
                    held.append(bool(out))
                    times.append(many)
                    ends.append(total)
                    if size >= 2 * CHUNK_BYTES:
                        yield from flush()
        if ids:
            yield from flush()

    return docs.select("doc_id", "held_out", "times", "text").mapInArrow(run, schema)


def by_chunk(counted: DataFrame) -> DataFrame:
    """counted: chunk, part (a word's number), c. The counts of each chunk in pieces, in order."""

    def run(batches):
        chunk, part, held = None, 0, np.zeros(0, dtype=np.int64)

        def cut(everything: bool):
            nonlocal part, held
            while len(held) >= WORDS or (everything and len(held)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([squeeze(held[:WORDS].astype("<i8"))], pa.binary())], names=["chunk", "part", "body"])
                part, held = part + 1, held[WORDS:]

        for b in batches:
            keys, c = b.column("chunk").to_numpy(), b.column("c").to_numpy()
            spans = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for at, to in zip(spans, spans[1:], strict=False):
                if at < to:
                    if chunk is not None and keys[at] != chunk:
                        yield from cut(True)
                        part = 0
                    chunk = int(keys[at])
                    held = np.concatenate((held, c[at:to]))
                    yield from cut(False)
        yield from cut(True)

    rows = counted.select("chunk", "part", "c").repartition("chunk").sortWithinPartitions("chunk", "part")
    return rows.select("chunk", "c").mapInArrow(run, "chunk bigint, part int, body binary")


class Prior:
    """What the counts alone say: totals of classes and parts, and the shares inside the rare class."""

    def __init__(self, n: int, v: int, once: int, twice: int, sums: np.ndarray) -> None:
        """sums: tokens of each class and part; of RARE the words seen once, in its first part."""
        self.n, self.v, self.once = n, v, once
        self.parts = sums.astype(float)
        weight = self.parts.sum(axis=1)
        total = np.maximum(weight, 1e-6)
        weight[RARE] += 1
        self.bias = np.log(np.maximum(weight, 1e-6) / weight.sum()).astype(np.float32)
        self.part_bias = np.log(np.maximum(self.parts, 1e-6) / total[:, None]).astype(np.float32)
        unseen = (once + 1) / (once + 2 * twice + 2) if once else 1.0
        self.log_unseen = float(np.log(unseen))
        self.log_once = float(np.log((1 - unseen) / once)) if once and unseen < 1 else float(np.log(0.5 / max(once, 1)))

    def log_in_part(self, c: np.ndarray, kind: np.ndarray, part: np.ndarray) -> np.ndarray:
        """log P(word | class and part), of RARE log P(word | class), for counts and effective classes."""
        own = np.log(np.maximum(c, 1) / np.maximum(self.parts[kind, part], 1))
        return np.where(c == 0, self.log_unseen, np.where(kind == RARE, self.log_once, own))

    def buckets(self) -> int:
        return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << (self.n // TOKENS).bit_length() - 1 if self.n >= TOKENS else 0))

    def weights(self) -> list[np.ndarray]:
        """For the class by previous word, skipped word and pair of classes (with the bias: one
        fires always), for the part by previous and skipped word."""
        b = self.buckets()
        shapes = [(b, CLASSES), (b, CLASSES), (CLASSES * CLASSES, CLASSES), (min(MOST_BUCKETS, 4 * b), PARTS), (min(MOST_BUCKETS, 4 * b), PARTS)]
        out = [np.zeros(shape, dtype=np.float32) for shape in shapes]
        out[2] += self.bias
        return out


def history(kind: np.ndarray, word: np.ndarray, starts: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of each of the weights that fire at each token. starts: a text begins here."""
    second = np.append(False, starts[:-1])

    def before(x: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.roll(x, 1), np.roll(x, 2)
        one[starts] = none
        two[starts | second] = none
        return one, two

    (one, two), (kind1, kind2) = before(word, 0), before(kind, END)
    b, p = len(weights[0]), len(weights[3])

    def with_class(x: np.ndarray) -> np.ndarray:
        mixed = (x.astype(np.uint64) + kind.astype(np.uint64) * np.uint64(0x9E3779B1)) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)) % np.uint64(p)

    return [r.astype(np.uint16) for r in (one % b, two % b, kind1 * CLASSES + kind2, with_class(one), with_class(two))]


def logits(weights: list[np.ndarray], rows: list[np.ndarray], bias: np.ndarray | None = None) -> np.ndarray:
    z = weights[0].take(rows[0], axis=0)
    for w, r in zip(weights[1:], rows[1:], strict=True):
        z += w.take(r, axis=0)
    if bias is not None:
        z += bias
    return np.clip(z, -60, 60, out=z)


def summed(g: np.ndarray, order: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the rows of g that order lists from each of first on, size of them each; longest come first.

    Long runs are added up one by one, the j-th rows of all short ones together: add.reduceat
    takes a call for each run and column.
    """
    long = int(np.searchsorted(-size, -SHORT))
    out = g.take(order[first], axis=0)
    for k in range(long):
        out[k] = g.take(order[first[k] : first[k] + size[k]], axis=0).sum(axis=0)
    for j in range(1, int(size[long]) if long < len(size) else 0):
        to = int(np.searchsorted(-size, -j))
        out[long:to] += g.take(order[first[long:to] + j], axis=0)
    return out


def descend(own: list[np.ndarray], grown: list[np.ndarray], used: list[np.ndarray], rows: list[np.ndarray], target: np.ndarray, rate: float, bias: np.ndarray | None = None) -> None:
    """A gradient step of one softmax. grown: sums of squares; used: how often each row fired."""
    g = np.empty((len(target), own[0].shape[1]), dtype=np.float32)
    for at in range(0, len(g), SLICE):
        cut = slice(at, at + SLICE)
        z = logits(own, [r[cut] for r in rows], None if bias is None else bias[cut])
        np.exp(z, out=z)
        np.divide(z, np.einsum("ij->i", z)[:, None], out=g[cut])
    g[np.arange(len(g)), target] -= 1
    for w, squares, often, r in zip(own, grown, used, rows, strict=True):
        order = np.argsort(r, kind="stable")
        ordered = r[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        size = np.diff(np.append(first, len(r)))
        by = np.argsort(-size, kind="stable")
        first, size = first[by], size[by]
        sums = summed(g, order, first, size)
        at = ordered[first].astype(np.intp)
        square = squares.take(at, axis=0)
        square += sums * sums
        squares[at] = square
        np.sqrt(square, out=square)
        sums *= np.float32(rate)
        sums /= square
        w[at] = w.take(at, axis=0) - sums
        often[at] += size.astype(np.float32)


class Model:
    """The factors' weights and the prior."""

    def __init__(self, prior: Prior, weights: list[np.ndarray]) -> None:
        self.prior, self.weights = prior, weights

    def log_probabilities(self, c: np.ndarray, effective: np.ndarray, part: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        """log P of each token."""
        p = self.prior.log_in_part(c, effective, part)
        for at in range(0, len(c), SLICE):
            cut = slice(at, at + SLICE)
            z = logits(self.weights[:3], [r[cut] for r in rows[:3]])
            p[cut] += z[np.arange(len(z)), effective[cut]] - np.log(np.einsum("ij->i", np.exp(z)))
            common = np.flatnonzero(effective[cut] != RARE)
            own = effective[cut][common]
            z = logits(self.weights[3:], [r[cut][common] for r in rows[3:]], self.prior.part_bias[own])
            p[at + common] += z[np.arange(len(z)), part[cut][common]] - np.log(np.einsum("ij->i", np.exp(z)))
        return p


def together(packed: DataFrame, arrays: DataFrame, number_of: int) -> DataFrame:
    """Each chunk's counts, words and texts in one task, in this order."""
    counts = arrays.withColumn("kind", F.lit(COUNTS))
    rows = packed.where(F.col("kind").isin(ABOUT, TEXTS)).select("chunk", "kind", "part", "ids", "held", "times", "ends", "body").unionByName(counts, allowMissingColumns=True)
    return rows.repartitionById(number_of, (F.col("chunk") % number_of).cast("int")).sortWithinPartitions("chunk", "kind", "part")


def pieces(batches, keep_held: bool, weights: list[np.ndarray]):
    """(ids, held, times, c, effective class, part, rows of the weights, lengths) of the texts of each piece."""
    chunk, counts, about, known = None, [], [], None
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            if row["chunk"] != chunk:
                chunk, counts, about, known = row["chunk"], [], [], None
            if row["kind"] == COUNTS:
                counts.append(expand(row["body"], "<i8"))
                continue
            if row["kind"] == ABOUT:
                about.append(expand(row["body"], "<u4").reshape(2, -1))
                continue
            if known is None:
                c = np.concatenate(counts)
                word, kind = np.concatenate(about, axis=1)
                kind = kind.astype(np.int32)
                known = c, word, kind, np.where((c == 0) | ((c < 2) & (kind != END)), RARE, kind).astype(np.int32)
                counts, about = [], []
            c, word, kind, effective = known
            tokens, ids, held, times = unpack_tokens(row["body"]), row["ids"], row["held"], row["times"]
            lengths = np.diff(np.concatenate(([0], np.frombuffer(row["ends"], dtype="<i8"))))
            learn = np.ones(len(ids), dtype=bool) if keep_held else ~np.array(held, dtype=bool)
            if not learn.all():
                tokens, lengths = tokens[np.repeat(learn, lengths)], lengths[learn]
            if len(tokens):
                starts = np.zeros(len(tokens), dtype=bool)
                starts[np.cumsum(lengths) - lengths] = True
                own = word[tokens]
                # The part comes from the hash's lowest of these bits; RARE has one part.
                part = np.where(effective[tokens] == RARE, 0, own % PARTS).astype(np.int32)
                yield ids, held, times, c[tokens], effective[tokens], part, history(kind[tokens], own, starts, weights), lengths


def train_round(ready: DataFrame, model: Model, rate: float = 0.3) -> list[np.ndarray]:
    """Gradient steps over the learned texts of some chunks; the tasks' changes averaged."""
    shared = ready.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_BUCKETS, whatever the corpus

    def run(batches):
        start, bias = shared.value.weights, shared.value.prior.part_bias
        own, grown = [w.copy() for w in start], [np.full(w.shape, 1.0, dtype=np.float32) for w in start]
        used = [np.zeros(len(w), dtype=np.float32) for w in start]
        for _, _, _, _, kind, part, rows, _ in pieces(batches, False, start):
            for at in range(0, len(kind), STEP):
                cut = slice(at, at + STEP)
                descend(own[:3], grown[:3], used[:3], [r[cut] for r in rows[:3]], kind[cut], rate)
                common = np.flatnonzero(kind[cut] != RARE)
                if len(common):
                    descend(own[3:], grown[3:], used[3:], [r[cut][common] for r in rows[3:]], part[cut][common], rate, bias[kind[cut][common]])
        task = TaskContext.get().partitionId()
        for k, (new, old, often) in enumerate(zip(own, start, used, strict=True)):
            # A row's change counts by how often it fired here.
            change = np.concatenate(((new - old) * often[:, None], often[:, None]), axis=1)
            at = [x for x in range(0, len(change), BLOCK) if often[x : x + BLOCK].any()]
            if at:
                blocks = [change[x : x + BLOCK].astype("<f4").tobytes() for x in at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array([x // BLOCK for x in at], pa.int64()), pa.array(np.full(len(at), task)), pa.array(blocks, pa.binary())], names=["array", "block", "part", "change"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part", kind="stable")
        total = np.sum([np.frombuffer(x, dtype="<f4") for x in pdf["change"]], axis=0, dtype=np.float64).astype("<f4")
        return pd.DataFrame({"array": [pdf["array"].iloc[0]], "block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "change": [total.tobytes()]})

    schema = "array bigint, block bigint, part bigint, change binary"
    changes = ready.mapInArrow(run, schema)
    for _ in range(3):  # FAN changes are added in one task: enough for FAN^3 tasks
        changes = changes.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("array", "block", "part").applyInPandas(add, schema)
    out = [w.copy() for w in model.weights]
    for r in changes.collect():  # a row for each block of the weights
        w = out[r["array"]]
        change = np.frombuffer(r["change"], dtype="<f4").reshape(-1, w.shape[1] + 1)
        w[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += change[:, :-1] / np.maximum(change[:, -1:], 1)
    return out


class Learned:
    """The texts as chunks with the counts of their words, and the model."""

    def __init__(self, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> None:
        rows = plain(docs, doc_id=id_col, text=F.col(f"`{text_col}`").cast("binary")).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
        self.id_type = rows.schema["doc_id"].dataType.simpleString()
        ordered, self.number_of = placed(rows)
        self.packed = materialize(chunks(ordered, self.number_of))
        # A word has a row for each chunk that uses it: its rows meet once, and go back with the sum.
        word = Window.partitionBy("h")
        words = self.packed.where(F.col("kind") == VOCABULARY).select("h", "chunk", "part", "n", "class")
        mod = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("sub")
        counted = words.withColumn("c", F.sum("n").over(word)).withColumn("first", F.row_number().over(word.orderBy("chunk")) == 1)
        counted = materialize(counted.select("chunk", "part", "c", "class", mod, "first"))
        rare = (F.col("c") < 2) & (F.col("class") != END)
        kind, sub = F.when(rare, RARE).otherwise(F.col("class")), F.when(rare, 0).otherwise(F.col("sub"))
        totals = [F.sum("c").alias("c"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("once"), F.count_if(F.col("c") == 2).alias("twice")]
        sums, n, v, once, twice = np.zeros((CLASSES, PARTS)), 0, 0, 0, 0
        for r in counted.where("first and c > 0").groupBy(kind.alias("kind"), sub.alias("sub")).agg(*totals).collect():  # CLASSES * PARTS rows
            sums[r["kind"], r["sub"]] = r["c"]
            n, v, once, twice = n + r["c"], v + r["v"], once + r["once"], twice + r["twice"]
        self.arrays = materialize(by_chunk(counted))
        discard(counted)
        prior = Prior(n, v, once, twice, sums)
        self.model = Model(prior, prior.weights())
        for k in range(min(SYNCS, self.number_of) if n else 0):
            own = F.pmod(F.col("chunk") % self.number_of, F.lit(min(SYNCS, self.number_of))) == k
            ready = together(self.packed.where(own), self.arrays.where(own), self.number_of)
            self.model = Model(prior, train_round(ready, self.model))

    def scores(self) -> DataFrame:
        shared = self.packed.sparkSession.sparkContext.broadcast(self.model)

        def run(batches):
            model = shared.value
            prior, id_kind = model.prior, []

            def typed(batches):
                for b in batches:
                    id_kind[:] = [b.schema.field("ids").type.value_type]
                    yield b

            for ids, held, times, c, effective, part, rows, lengths in pieces(typed(batches), True, model.weights):
                base = np.log10(c + 1.0) - np.log10(prior.n + prior.v + 1.0)
                p = model.log_probabilities(c, effective, part, rows) / np.log(10)
                first = np.cumsum(lengths) - lengths
                add = lambda x: pa.array(np.add.reduceat(x, first))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, id_kind[0]), pa.array(held, pa.bool_()), pa.array(times, pa.int64()), pa.array(lengths), add((c > 0).astype(np.int64)), pa.array(np.full(len(lengths), prior.n)), add(base), add(p)],
                    names=["doc_id", "held_out", "times", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

        schema = f"doc_id {self.id_type}, held_out boolean, times bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
        scored = together(self.packed, self.arrays, self.number_of).mapInArrow(run, schema)
        return repeated(scored, "times").drop("times")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    held_out: a condition on doc_id; those rows are scored and never learned from.
    """
    return Learned(docs, held_out, id_col, text_col).scores()
