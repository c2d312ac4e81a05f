import pytest


@pytest.fixture()
def docs(spark):
    """A documents table of (doc_id, text) pairs, with an extra column of a clashing name."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars", *(["1 as rank", "'x' as spans"] if extra else []))

    return make
