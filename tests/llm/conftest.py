import pytest
from pyspark.sql import functions as F

#: Rows that every operator must take: nulls, empty and odd texts, ties, repeated rows, clashing column names.
ROWS = [
    (5, "The cat sat on the mat and looked at the dog for a while.", "en", "a", 10),
    (4, None, "en", None, None),
    (3, "", None, "b", 0),
    (3, "", None, "b", 0),
    (None, "A text without an id.", "en", "b", 3),
    (2, "The cat sat on the mat and looked at the dog for a while.", "en", "a", 10),
    (1, " \n\t ", "de", "c", 3),
    (0, "word " * 30_000 + "ä€😀", "fr", "a", 1),
    (7, "x" * 50_000, "fr", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """ROWS with columns whose names clash with those of results."""
    names = (
        "n_words", "n_tokens", "score", "fingerprint", "class_id", "n_links", "block", "rep", "root", "part", "kept", "failed", "label", "id", "turn", "pass", "weight", "tokens", "found", "new", "values", "n_values",
        "row", "copy", "copies", "key", "content", "node", "class", "paths", "n_grams", "n", "__found", "__new", "__values", "__id", "__key", "__content", "__copies", "__copy", "__block", "__turn", "odd name`s",
    )
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
