import pytest


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns whose names clash with working names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "the QUICK brown fox jumps over the lazy dog", "en", "a", 43),
        (2, "the QUICK brown fox jumps over the lazy dog", "en", "a", 43),
        (3, None, "en", "b", None), (4, "", None, "b", 0), (5, " \n\t ", "de", None, 4),
        (None, "a text without an id, in its own words", None, None, 5), (6, "one", "fr", "c", 3),
        (7, "wort " * 3000, "de", "c", 15000), (8, "x" * 5000 + " é ß, l'été", "fr", "c", 5010),
        (9, "The quick brown fox jumps over the lazy cat", "en", "a", 43), (None, None, None, None, None),
    ]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.selectExpr("*", "1 as _digest", "2 as kept", "3 as size", "4 as offset", "5 as `_score`", "'k' as key", "7 as id")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
