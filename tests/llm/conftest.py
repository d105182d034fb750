import pyarrow.parquet as pq
import pytest
from pyspark.sql import Row

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return SMALL


def rows_of(name):
    return pq.read_table(f"{SMALL}/{name}.parquet").to_pylist()


LONG = "lorem ipsum dolor sit amet " * 40_000


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    texts = [
        (1, "a b c d e f g h i j", "s0"), (2, "", "s0"), (3, None, "s1"), (4, LONG, None), (5, "x", "s2"),
        (5, "x", "s2"), (None, "no id here at all", "s1"), (None, None, None), (6, " \n\t ", "s0"),
        (7, "naïve ünïcode 😀 text\nwith lines", "s1"), (8, "a b c d e f g h i j", "s1"),
    ]
    rows = [(i, t, "en", s, len(t or ""), "other", 3.5, "z") for i, t, s in texts]
    return spark.createDataFrame(rows, DOC + ", TEXT string, size double, Row string")


def no_documents(spark):
    return spark.createDataFrame([], DOC)


def collected(df):
    return [Row(**r.asDict()) for r in df.collect()]
