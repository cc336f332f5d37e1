"""Language identification with string kernels.

The kernel of two texts is the blended-spectrum presence kernel: the number of letter n-grams
(n = 1 to 3, anything but letters read as one separator) that both hold, over the root of the
numbers that each holds. Nyström landmarks turn it into features, and one-versus-rest kernel
ridge regression is fitted on them. As the kernel with a landmark is a product of presence
vectors, the regression folds into one matrix (n-grams of the landmarks by languages): a batch
of whole texts is scored by one product of its presence matrix with it.

The n-grams are of all letters of all scripts, hashed into a presence space of 2^SPACE columns.

The fit uses a bounded sample of every language: `train_rows` rows over their number, 8 at least;
of a text over `max_chars` seeded windows of the whole. With many languages the windows get
shorter, so that the sample stays bounded. Scoring covers all rows and whole texts.

A null text, or one without a letter, is `und` with score 0. Without any row to learn from (an
empty table gives no rows), every other text is `und` too. Equal outputs go to the language that
sorts first. Rows of one id and text count once in the sample and are predicted each. A very long
text is predicted whole. Other columns of the input play no part, whatever their names.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_sample, plain

#: Columns of the presence space, in bits, and windows of a long text that is learned from.
SPACE, WINDOWS = 21, 8


class KernelModel:
    """Folded kernel ridge regression over presence n-grams."""

    def __init__(self, grams: np.ndarray, matrix: np.ndarray, classes: list[str]) -> None:
        self.grams, self.matrix, self.classes = grams, matrix, classes

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("grams", "matrix", "classes")}

    @cached_property
    def symbol_of(self) -> np.ndarray:
        """The lower-case letter of each code point, 0 for anything but letters."""
        table = np.zeros(0x110000, dtype=np.uint32)
        for code in range(0x110000):
            c = chr(code)
            if c.isalpha():
                low = c.lower()
                table[code] = ord(low) if len(low) == 1 else code
        return table

    @cached_property
    def column_of(self) -> np.ndarray:
        table = np.full(1 << SPACE, len(self.grams), dtype=np.int32)
        table[self.grams] = np.arange(len(self.grams))
        return table

    @cached_property
    def stamp(self) -> np.ndarray:
        return np.zeros(1 << SPACE, dtype=np.int32)

    def codes(self, text: str) -> np.ndarray:
        """A code for each place and length of n-gram; none for separators alone, or without letters."""
        s = self.symbol_of[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)].astype(np.uint64)
        s = s[np.append(True, (s[1:] > 0) | (s[:-1] > 0))] if len(s) else s
        if not s.any():
            return np.zeros(0, dtype=np.int64)
        # 21 bits a letter make an n-gram one number, which is hashed; the top bit marks pairs.
        two = s[:-1] << np.uint64(21) | s[1:]
        three = two[:-1] << np.uint64(21) | s[2:]
        mixed = np.concatenate((s[s > 0], two + np.uint64(1 << 63), three)) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - SPACE)).astype(np.int64)

    def distinct(self, codes: np.ndarray) -> np.ndarray:
        order = np.arange(len(codes), dtype=np.int32)
        self.stamp[codes] = order
        return codes[self.stamp[codes] == order]

    def presence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Presence over the columns, and the number of n-grams, of each text."""
        out = np.zeros((len(texts), len(self.grams) + 1), dtype=np.float32)
        sizes = np.zeros(len(texts))
        for k, t in enumerate(texts):
            codes = self.codes(t)
            if len(codes):
                own = self.distinct(codes)
                sizes[k] = len(own)
                out[k, self.column_of[own]] = 1
        return out[:, :-1], sizes

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        have, sizes = self.presence(texts)
        if not self.classes:
            return ["und"] * len(texts), np.zeros(len(texts))
        f = have @ self.matrix / np.sqrt(np.maximum(sizes, 1))[:, None]
        # The outputs shrink alike with a short text: their size against each other is what counts.
        p = certainty(f)
        best = f.argmax(axis=1)
        none = sizes == 0
        return [("und" if n else self.classes[b]) for n, b in zip(none, best, strict=True)], np.where(none, 0.0, p)


def certainty(f: np.ndarray) -> np.ndarray:
    """How far each row's largest output stands out, whatever the number of languages: 0.25 for
    equal outputs, 0.95 for 1 against -1 for all others.

    A softmax of the largest and three rivals, the strongest ones (fewer count as three alike),
    with outputs over their root mean square.
    """
    if f.shape[1] < 2:
        return np.ones(len(f))
    high = np.sort(2 * f / np.maximum(np.sqrt((f * f).mean(axis=1, keepdims=True)), 1e-9), axis=1)[:, ::-1]
    return 1 / (1 + 3 * np.exp(high[:, 1:4] - high[:, :1]).mean(axis=1))


def fit(rows: list[tuple[str, str]], landmarks: int = 256, ridge: float = 1e-3) -> KernelModel:
    """rows: (language, text), in a fixed order that is as good as random."""
    classes = sorted({c for c, _ in rows})
    if not rows:
        return KernelModel(np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32), [])
    per = max(1, landmarks // len(classes))
    seen: dict[str, int] = {}
    chosen = []
    for c, t in rows:
        seen[c] = seen.get(c, 0) + 1
        if seen[c] <= per and t:
            chosen.append(t)
    model = KernelModel(np.zeros(0, dtype=np.int64), np.zeros((0, 0), dtype=np.float32), classes)
    found = [model.distinct(model.codes(t)) for t in chosen]
    model.grams = np.unique(np.concatenate(found)).astype(np.int64) if found else model.grams
    marks, sizes = model.presence(chosen)
    marks /= np.sqrt(np.maximum(sizes, 1))[:, None].astype(np.float32)
    kernel = (marks @ marks.T).astype(float)
    value, vector = np.linalg.eigh(kernel)
    keep = value > 1e-8 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])  # K^(-1/2): landmarks to features
    features = []
    for at in range(0, len(rows), 128):
        have, n = model.presence([t for _, t in rows[at : at + 128]])
        features.append((have @ marks.T / np.sqrt(np.maximum(n, 1))[:, None]) @ root)
    z = np.concatenate(features)
    y = np.where(np.array([c for c, _ in rows])[:, None] == np.array(classes)[None, :], 1.0, -1.0)
    weight = 1 / np.array([seen[c] for c, _ in rows])  # languages count alike
    solved = np.linalg.solve((z * weight[:, None]).T @ z + ridge * np.eye(z.shape[1]), (z * weight[:, None]).T @ y)
    model.matrix = (marks.T @ (root @ solved)).astype(np.float32)
    return model


def windows(text: Column, key: Column, chars: int) -> Column:
    """The text, or of one over `chars` characters WINDOWS windows at places that a hash of key chooses."""
    width = (chars - WINDOWS) // WINDOWS
    places = [F.pmod(F.xxhash64(key, F.lit(k)), F.length(text) - width + 1).cast("int") + 1 for k in range(WINDOWS)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *[F.substring(text, at, F.lit(width)) for at in places]))


def train(docs: DataFrame, learn: Column, landmarks: int = 256, train_rows: int = 1600, max_chars: int = 20_000) -> KernelModel:
    """docs: doc_id, text, lang. learn: which rows may be learned from."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = known.select("lang").distinct().count()
    if not n:
        return fit([])
    chars = max(800, min(max_chars, max_chars * 64 // n))
    short = known.select("lang", windows(F.col("text"), F.col("doc_id"), chars).alias("text"), "doc_id")
    rows = bounded_sample(short, "lang", F.col("doc_id"), max(8, train_rows // n), chars)
    return fit([(r["lang"], r["text"]) for r in rows], landmarks)


def predict(docs: DataFrame, model: KernelModel) -> DataFrame:
    """docs: doc_id, text and any others, which stay; adds lang_pred and score, drops text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the number of languages and the sample bound it
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "lang_pred string", "score double"])

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                names, scores = model.score([(x or b"").decode("utf-8", "replace") for x in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(names, pa.string()), pa.array(scores.astype(float))], names=[*(f.name for f in rest), "lang_pred", "score"])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def identify(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows not held out."""
    rows = plain(docs, doc_id=id_col, text=text_col, lang=lang_col, held_out=held_out)
    model = train(rows, ~F.col("held_out"), **options)
    return predict(rows.select("doc_id", "held_out", "text"), model)
