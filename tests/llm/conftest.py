import pytest

LONG = ("word " * 3000 + "\n") * 3 + "x" * 5000


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns that clash with outputs."""
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 0, "x", 1.0, None),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 0, "x", 1.0, None),
        (2, None, "en", "a", None, None, None, None),
        (None, "no id here but some words to read and count", None, None, 3, "y", 2.0, 1),
        (3, "", None, "b", 0, "z", None, 2),
        (4, " \t\n ", "fr", None, 0, "z", None, 2),
        (5, LONG, "de", "b", 0, "z", None, 2),
        (6, "ünï çödé 😀 😀 tail", "fr", "é", 0, "z", None, 2),
        (None, None, None, None, None, None, None, None),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, Size string, score double, slot int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
