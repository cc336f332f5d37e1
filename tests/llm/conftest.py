import pytest


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: Nulls, empty and very long texts, repeated rows, and extra columns with clashing names.
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (1, "the quick brown fox jumps over the lazy dog", "en", "a", 43),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "a text without any id", "en", None, 21),
    (4, "1234 !!! ***", None, "b", 12),
    (5, "word " * 60_000, "en", "b", 300_000),
    (6, "x" * 100_000, "fr", "c", 100_000),
    (7, "le chat noir et la souris grise 🙂 中文 ñandú", "fr", "c", 40),
    (8, " \t\n\r\x0b\x0c ", "en", "c", 7),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("score", "size", "fp", "chunk", "task", "number", "k1", "held_out", "w", "license", "h", "n", "part"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
