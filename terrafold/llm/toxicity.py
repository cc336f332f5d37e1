"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts, the rest is unlabelled text of which an unknown part is
toxic. The classifier is logistic over presence features (words of letters, and their prefixes
of 4 to 6 letters, which stand for inflected forms). It minimises the class-prior-corrected risk
pi R_p(+) + max(0, R_u(-) - pi R_p(-)); where the second part falls below zero, a step goes
against it instead (non-negative correction), so that the classifier can't learn the positives by
heart. The class prior is the share of toxic rows among the labelled rows learned from.

Fitted on a bounded sample: `positives` and `unlabelled` rows at most, none over `max_chars`.
Features are those whose share among the positives differs clearly (`least_z`) from that in
unlabelled text. Scoring covers all rows and whole texts.

A null text is scored as the empty one: no features. Without any positive (an empty table of
labels, too), every score is 0. Repeated rows and repeated labels count once in the sample; an id
of several texts counts with each. A very long text is scored whole, and not learned from beyond
`max_chars`. Other columns of the input play no part, whatever their names. An empty table of
documents gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import bounded_sample, plain

_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
#: Words whose features a worker remembers.
MEMO = 300_000


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(text: str) -> set[str]:
    own = words(text)
    return own | {w[:k] + "*" for w in own for k in PREFIXES if len(w) > k}


class Model:
    def __init__(self, weights: dict[str, float], bias: float | None) -> None:
        self.bias = bias
        self.column = {f: k for k, f in enumerate(weights)}
        self.weights = np.array(list(weights.values()), dtype=float)
        self.heads = {f[:3].rstrip("*") for f in weights}
        self.known: dict[str, list[int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def columns(self, word: str) -> list[int]:
        """The columns of a word's features."""
        if word[:3] not in self.heads:
            return []
        own = (word, *(word[:k] + "*" for k in PREFIXES if len(word) > k))
        return [self.column[f] for f in own if f in self.column]

    def score(self, text: str) -> float:
        return float(self.scores([text])[0])

    def scores(self, texts: list[str]) -> np.ndarray:
        """The score of every text: one sparse product of its presence rows with the weights."""
        if self.bias is None:
            return np.zeros(len(texts))
        if len(self.known) > MEMO:
            self.known.clear()
        known, who, what = self.known, [], []
        for k, t in enumerate(texts):
            own: list[int] = []
            for w in words(t):
                found = known.get(w)
                if found is None:
                    found = self.columns(w)
                    if len(w) <= 32:
                        known[w] = found
                own += found
            who += [k] * len(own)
            what += own
        if not what:
            return np.full(len(texts), 1 / (1 + np.exp(-np.clip(self.bias, -30, 30))))
        # A feature counts once a text; in the order of columns, so that sums agree everywhere.
        cells = np.unique(np.array(who, dtype=np.int64) * len(self.weights) + np.array(what, dtype=np.int64))
        z = self.bias + np.bincount(cells // len(self.weights), self.weights[cells % len(self.weights)], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: list[str], unlabelled: list[str], prior: float, least_z: float = 4.0, most: int = 20_000, rounds: int = 1600, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Full-batch steps (Adam) over the sample."""
    if not positive or not unlabelled:
        return Model({}, None)
    prior = min(max(prior, 1e-4), 0.9)
    in_p = Counter(f for t in positive for f in features(t))
    least = max(2, min(5, len(positive) // 10))
    maybe = {f for f, n in in_p.items() if n >= least}
    in_u = Counter(f for t in unlabelled for f in features(t) & maybe)
    n_p, n_u = len(positive), len(unlabelled)

    def z(f: str) -> float:
        p, u = in_p[f] / n_p, (in_u[f] + 0.5) / (n_u + 1)
        s = (in_p[f] + in_u[f]) / (n_p + n_u)
        return abs(p - u) / np.sqrt(s * (1 - s) * (1 / n_p + 1 / n_u) + 1e-12)

    names = sorted((f for f in maybe if z(f) >= least_z), key=lambda f: (-z(f), f))[:most]
    column = {f: k for k, f in enumerate(names)}

    def rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        who, what = [], []
        for k, t in enumerate(texts):
            own = [column[f] for f in features(t) if f in column]
            who += [k] * len(own)
            what += own
        return np.array(who, dtype=np.int64), np.array(what, dtype=np.int64)

    (who_p, what_p), (who_u, what_u) = rows(positive), rows(unlabelled)
    w, bias = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, rounds + 1):
        z_p = bias + np.bincount(who_p, w[what_p], n_p)
        z_u = bias + np.bincount(who_u, w[what_u], n_u)
        s_p, s_u = sigmoid(z_p), sigmoid(z_u)
        rest = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        # d/dz of the loss: -(1 - s) as a positive, s as a negative.
        if rest >= 0:
            g_p, g_u = (-prior * (1 - s_p) - prior * s_p) / n_p, s_u / n_u
        else:
            g_p, g_u = prior * s_p / n_p, -s_u / n_u
        g = np.append(np.bincount(what_p, g_p[who_p], len(names)) + np.bincount(what_u, g_u[who_u], len(names)) + decay * w, g_p.sum() + g_u.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return Model(dict(zip(names, w.tolist(), strict=True)), float(bias))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positives: int = 2000, unlabelled: int = 6000, max_chars: int = 20_000) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. learn: on doc_id, which rows may be learned from."""
    known = labels.where(learn & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not toxic:
        return Model({}, None)
    # A hash threshold bounds the ids that are broadcast: 1.2 * positives + 50 in expectation.
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(23)), 11).cast("double") / float(2**53)
    chosen = known.where(F.col("toxic") == 1).where(u <= min(1.0, (1.2 * positives + 50) / toxic)).select("doc_id")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.lit(1).alias("all"))
    confirmed = bounded_sample(texts.join(F.broadcast(chosen), "doc_id"), "all", F.col("doc_id"), positives, max_chars)
    free = bounded_sample(texts.where(learn), "all", F.col("doc_id"), unlabelled, max_chars)
    return fit([r["text"] for r in confirmed], [r["text"] for r in free], toxic / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs: doc_id, text and any others, which stay; adds score, drops text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # `most` features at most
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "score double"])

    def run(batches):
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                scores = model.scores([(x or b"").decode("utf-8", "replace") for x in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in rest), pa.array(scores, pa.float64())], names=[*(f.name for f in rest), "score"])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, held_out, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. held_out: Column of a column doc_id."""
    rows = plain(docs, doc_id=id_col, text=text_col)
    model = train(rows, plain(labels, doc_id="doc_id", toxic="toxic"), ~held_out, **options)
    scored = score(rows.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
