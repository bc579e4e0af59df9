import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
#: Columns whose names the operators use themselves.
CLASHES = ["doc", "row", "kept_text", "n_lines", "n_words", "score", "shard", "slot", "text_key", "spans", "key", "label", "start"]


def words(n, seed):
    return " ".join(f"w{seed}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ties, and a very long text."""
    line = "a line that three documents hold together"
    return [
        (1, "one two three\n" + line, "en", "s", 13),
        (2, "one two three\n" + line, "en", "s", 13),
        (2, "one two three\n" + line, "en", "s", 13),
        (3, line + "\nTAIL", None, None, None),
        (4, "", "en", "s", 0),
        (5, None, "en", "s", None),
        (None, "no id at all\n" + line, "en", "s", 5),
        (None, None, None, None, None),
        (6, " \t\x0b ", "en", "s", 4),
        (7, words(30_000, 1), "en", "s", 1),
        (8, words(40, 2) + " " + words(20, 3), "en", "s", 1),
        (9, words(25, 2), "en", "s", 1),
        (10, "x" * 5000, "en", "s", 1),
        (11, "é日本 <|endoftext|> Σς", "fr", "s", 1),
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns of clashing names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, DOCUMENTS)
    return docs.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
