import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"
LONG = "word " * 30_000

#: Nulls, empty texts, repeated rows, odd characters, very long texts.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "  \n\t ", "en", "a", 5),
    (4, "one", "en", None, 3),
    (4, "one", "en", None, 3),
    (5, "It's the users' <|endoftext|> don't\n\n\n  x  ", "en", "a", 1),
    (6, "日本語 のテキスト   ¿Qué? İstanbul ΑΣ", None, "a", 1),
    (7, LONG, "en", "a", len(LONG)),
    (None, "no id here at all", "de", "b", 1),
    (8, "x" * 9000, "de", "b", 9000),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with further columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, DOCUMENTS).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("h", "n", "row", "rows", "score", "sequence", "band", "known", "class_id", "size")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
