import pytest

#: Null, empty, blank, short, long, tied and repeated texts.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, "the quick", "en", "a"),
    (5, "Der schnelle braune Fuchs springt über den faulen Hund am Fluss", "de", "b"),
    (6, "long words " * 20000, "en", "a"),
    (7, "The quick brown  fox\tjumps over the lazy dog near the river bank today", "en", "a"),
    (7, "The quick brown  fox\tjumps over the lazy dog near the river bank today", "en", "a"),
    (8, " \n\t ", "de", None),
    (9, "12345 !!! 67890", None, "b"),
    (10, "x" * 150_000, "en", "b"),
    (None, "a row without an id", "en", None),
    (11, "日本語のテキスト 😀 <|endoftext|> done ▁ x", None, "b"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents with columns named like results and working columns."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(TEXTS, SCHEMA).repartition(3, "doc_id")
    return df.withColumn("score", F.lit("s")).withColumn("ids", F.lit(1)).withColumn("node", F.lit(2)).withColumn("digest", F.lit("d")).withColumn("n_tokens", F.lit("x")).withColumn("block", F.lit(0))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
