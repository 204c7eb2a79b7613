import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Rows of (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """NULLs, empty and long texts, repeated rows, ids far apart."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood "
    return make_docs(
        [
            (1, None, None),
            (2, "", "a"),
            (3, base, "a"),
            (3, base, "a"),
            (7, base, None),
            (None, base + "x", "b"),
            (None, None, None),
            (2**40, base * 400, "b"),
            (-5, "word", "b"),
            (10**15, "\ud7ff é ñ 語 \U0001f600 " * 3, "c"),
        ]
    )
