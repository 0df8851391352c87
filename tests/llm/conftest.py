import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

#: documents with columns whose names the operators use inside
NAMES = ("digest", "size", "owner", "class", "bucket", "score", "block", "shuffle", "key")
INNER = ("digest", "keep", "own", "turn", "times", "id", "source", "size", "nth", "has", "keys")
ODD = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())]
    + [T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in NAMES]
    + [T.StructField(f"__{n}", T.StringType()) for n in INNER]
)
LONG = " ".join(f"word{i % 977}x{i * i % 1013}" for i in range(30_000))


def odd_rows():
    texts = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one two three", "en", None), (5, "one two three", "en", None),
        (5, "one two three", "en", None), (None, "one two three", "fr", "b"), (7, LONG, "en", "b"), (8, LONG + " end", "en", "b"), (9, "日本語 é ü", "fr", "a"),
        (10, "single", "en", "c"), (11, "1234 !!! 55", "en", "c"), (12, "the MIT License and MIT license", "en", "a"),
    ]
    return [(i, t, g, s, len(t or ""), *["x"] * (len(NAMES) + len(INNER))) for i, t, g, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def docs(spark):
    from cutledger.llm.common import documents

    return documents(spark, SF)


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
