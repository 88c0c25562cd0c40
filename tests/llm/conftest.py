import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (id, text) pairs, with further columns named like the operators' own."""
    def build(rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
        return df.selectExpr("*", "1 as key", "2 as task", "'x' as spans", "3 as shard", "4 as bucket",
                             "5 as score", "6 as n", "7 as `group`", "8 as part")
    return build


@pytest.fixture(scope="session")
def odd():
    """NULL and empty texts, repeated rows, ties, one long text, marks and several scripts."""
    long = " ".join(f"word{i % 997} Straße, élan." for i in range(20_000))
    return [(1, None), (2, ""), (3, "One two three."), (3, "One two three."), (4, "One two three."),
            (None, "No id here"), (5, long), (6, "   "), (7, "\n\n a  b\tc \n"), (8, "x" * 5000),
            (9, "日本語のテキスト emoji 😀 é é <|endoftext|> <|ENDOFTEXT|>"), (10, "It's  I'LL.   end. ... ?! a.b"),
            (None, None), (2, "")]


@pytest.fixture(scope="session")
def texts(spark):
    """Rows of the smallest test table."""
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SMALL}/documents.parquet")
            .select("doc_id", "text").collect()]
