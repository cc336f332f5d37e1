"""A training corpus from `documents`: five operators in turn, each over what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import language_id, mixing, packing, simhash, toxicity
from terrafold.llm.common import arrow_filter, copies_of, materialize, row_keys, split_remainder

#: A document goes if its language is undetermined or scored below this.
LEAST_LANGUAGE = 0.35
#: A document goes if it is scored as toxic as this.
TOXIC = 0.7
#: Near duplicates share this part of their five-word shingles.
SIMILAR = 0.8


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter, or null, go. Without any learned language all go."""
    model = language_id.train(docs.select("doc_id", "text", "lang"), split_remainder("doc_id", 3) != 1)
    shared = spark.sparkContext.broadcast(model)

    def keep(texts: list[str]) -> list[bool]:
        names, scores = shared.value.score(texts)
        return [n != "und" and s >= LEAST_LANGUAGE for n, s in zip(names, scores.tolist(), strict=True)]

    return arrow_filter(docs, keep)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; a null text counts as empty and stays, repeated rows are judged alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select("doc_id", "text"), labels, split_remainder("doc_id", 3) != 1)
    shared = spark.sparkContext.broadcast(model)

    def keep(texts: list[str]) -> list[bool]:
        return (shared.value.scores(texts) < TOXIC).tolist()

    return arrow_filter(docs, keep)


def by_similarity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Texts are linked whose five-word shingles agree in SIMILAR or more; texts without words (and
    nulls) are one group. Rows of equal doc_id are told apart by their row key; a null doc_id
    comes last. An empty table gives no rows.
    """
    found = materialize(simhash.near_components(row_keys(docs), keep=("k1", "k2"), similarity=SIMILAR))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("k1"), F.col("k2"))
    first = found.groupBy("component").agg(F.min(order).alias("f")).select("f.k1", "f.k2")
    rows = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    return copies_of(docs, first.join(rows, ["k1", "k2"]).withColumn("copies", F.lit(1)))


def by_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are written as often as the mixture takes them, up to three times, whole.

    Empty and null texts are taken no times. Repeated rows count each. An empty table gives no rows.
    """
    mixed = mixing.mix(row_keys(docs), keep=("k1", "k2"))
    chosen = mixed.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"), F.sum("copies").alias("copies"))
    return copies_of(docs, materialize(chosen))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the training sequences; see packing for odd rows."""
    import public_tokenizers as public

    return packing.pack(docs, (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN))


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("near_duplicates", by_similarity),
    ("mixture", by_mixture),
    ("packing", into_sequences),
]

#: The stages learn models and tokenise: SQL can't express them (tests hold them against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
