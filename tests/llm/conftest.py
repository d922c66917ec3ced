import pytest

NULLS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    text = "one two three four five six seven eight nine ten " * 3
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (3, None, "en", "a", 0), (None, "tail", None, "b", 1), (4, "", "en", "a", 0)]
    rows += [(5, "é" * 70_000 + " x" * 70_000, "fr", "c", 1), (6, " \t\n", "en", "a", 3), (7, "Under the MIT License, 2.0 ünïcode \U0001f600\U0001f600", "en", "b", 1), (7, "other text", "en", "b", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, NULLS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], NULLS)
