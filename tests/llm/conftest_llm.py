import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

LONG = " ".join(f"word{i % 977}" for i in range(20_000))

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from the very old house", "en", "a", 1),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the very old house", None, None, None),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the very old house", None, None, None),
    (3, None, "en", "b", 0),
    (4, "", "en", "b", 0),
    (5, " \n\t \n", "de", "b", 5),
    (None, "a text without an id and with nothing else to say", "de", None, 3),
    (None, None, None, None, None),
    (6, "one", "fr", "c", 3),
    (7, LONG, "en", "a", 9),
    (8, LONG + " tail", "en", "a", 9),
    (-9, "Ünïcode ▁ text\x00with odd\r\nthings here \U0001f600\U0001f600 ​", "xx", "a", 1),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, odd characters."""
    return spark.createDataFrame(EDGE, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def crowded(df, *names):
    """``df`` with further columns that are called like results."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("theirs") for n in names if n not in df.columns})


def plain(rows):
    """Rows as sorted tuples, whatever has nulls."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))
