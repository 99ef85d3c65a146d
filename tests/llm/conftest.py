import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use themselves
        *[T.StructField(name, T.StringType()) for name in ("row", "pos", "name", "key", "score", "shard", "_digest", "_score", "position", "edge")],
    ]
)
EXTRA = ("x",) * 10
PLAIN = "The quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow again and again. "


def rows(*pairs):
    return [(key, text, "en", "s", None, *EXTRA) for key, text in pairs]


HARD = rows(
    (1, PLAIN),
    (2, PLAIN.upper()),
    (3, PLAIN),
    (3, PLAIN),
    (4, None),
    (5, ""),
    (None, PLAIN),
    (None, None),
    (6, "   \n\t "),
    (7, "é"),
    (8, "words " * 40_000 + PLAIN),
    (9, "\U0001f600 日本語 テキスト " + PLAIN + "!!! ???"),
    (10, PLAIN + "An ending of its own, long enough to be a match of nothing else in here."),
    (11, "x" * 300),
    (12, "x" * 300),
)


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing names."""
    nulls = [(13, "no other columns", *(None,) * 13)]
    return spark.createDataFrame(HARD + nulls, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
