"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.common import split_remainder
    from terrafold.llm.toxicity import detect

    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), split_remainder("doc_id", 3) == 1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.common import split_remainder
    from terrafold.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"), split_remainder("doc_id", 3) == 1)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    from terrafold.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN))


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from terrafold.llm.topk import search

    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.license_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from terrafold.llm.common import split_remainder
    from terrafold.llm.lm_score import score

    return score(table(spark, sf_dir, "documents"), split_remainder("doc_id", 7) == 2)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from terrafold.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds images: the media column is a picture of each page."""
    from terrafold.llm.media import find_copies, page_images

    return find_copies(page_images(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


QUERIES = {f.__name__: f for f in (op1_simhash_near_dedup, op2_mix_sources, op3_toxicity, op4_language_id, op5_best_fit_packing, op6_exact_topk, op7_license_scan, op8_lm_score, op9_token_counts, op10_media_copies)}


def _license_sql() -> str:
    """The windows of the scan and their shares of each template, without any band."""
    from terrafold.llm.license_scan import TEMPLATES, geometry

    rows = []
    for name, template in sorted(TEMPLATES.items()):
        words = re.findall(r"[^\W_]+", template.lower())
        own = [" ".join(words[k : k + 5]) for k in range(len(words) - 4)]
        stride, length = geometry(len(own))
        rows += [f"('{name}', '{x}', {len(set(own))}, {stride}, {length})" for x in sorted(set(own))]
    return f"""
WITH t(license, shingle, n, stride, length) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 4))) AS i FROM w),
h AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] || ' ' || w[i + 5] AS shingle FROM s),
m AS (SELECT doc_id, i, license, shingle, n, unnest(range(greatest(0, CAST(ceil((i - length + 1) / stride) AS BIGINT)), CAST(floor(i / stride) AS BIGINT) + 1)) AS j FROM h JOIN t USING (shingle)),
c AS (SELECT doc_id, license, j, count(DISTINCT shingle) / any_value(n) AS share, min(i) AS place FROM m GROUP BY 1, 2, 3 HAVING count(DISTINCT shingle) >= 0.8 * any_value(n))
SELECT doc_id, license, max(share) AS containment, min(place) AS first_word, count(*) AS windows FROM c GROUP BY 1, 2"""


ORACLE_SQL: dict[str, str] = {
    "op6_exact_topk": """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda t: t[1] * t[2])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, cr) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op7_license_scan": _license_sql(),
}
