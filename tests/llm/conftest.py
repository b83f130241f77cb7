import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    import duckdb

    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


#: Rows that every operator must take: nulls, empty and blank texts, ties, a repeated row, a long text, odd characters.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (4, "one", "xx", "a"), (None, "a text without a number is still a text of ten words", "en", "a"), (5, "same words here " * 40, "en", "a"), (5, "same words here " * 40, "en", "a"),
    (6, "\U0001f600 éß中文 <b> & \x01 café́", "en", "b"), (7, "x" * 5000, "en", "b"), (8, "\n".join(f"line {i} of a rather long text that goes on and on" for i in range(3000)), "en", "b"), (None, None, None, None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """ODD with further columns whose names clash with names that the operators use."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("n_chars", "score", "kept", "rank", "id", "place", "text_hash", "band", "key", "item_id", "lines", "words")})


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("1 = 0")


