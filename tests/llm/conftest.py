import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    """(doc_id, text) of the small table, for brute force."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, ties, clashing extra columns."""
    rows = [
        (1, None, "x", "k"),
        (2, "", None, "k"),
        (3, " \t\n ", "x", None),
        (4, "one", "x", "k"),
        (5, "one", "x", "k"),
        (5, "one", "x", "k"),
        (6, "one  two\nthree", "x", "k"),
        (7, "one two three", "x", "k"),
        (8, "word " * 30_000, "x", "k"),
        (9, "ÀÉ ß İ   x", "x", "k"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, h string, component string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
