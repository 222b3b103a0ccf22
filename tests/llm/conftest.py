import pytest

DOCS = "doc_id long, text string, lang string, source string, size int, keep_id string, fp string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    long_text = "lorem ipsum dolor sit amet " * 4000
    rows = [
        (1, "One two three four five six.", "en", "b", 1, "x", None),
        (2, "One  two\tthree four\nfive six.", "en", "a", None, "y", "f"),
        (2, "One  two\tthree four\nfive six.", "en", "a", None, "y", "f"),
        (3, None, None, None, None, None, None),
        (4, "", "fr", "a", 7, "z", "g"),
        (None, "One two three four five six.", "en", "c", 1, "x", None),
        (None, None, None, None, None, None, None),
        (7, long_text, "la", "a", 3, "q", "h"),
        (8, long_text + "end", "la", "b", 3, "q", "h"),
        (9, " \n\t ", "en", "c", 3, "q", "h"),
        (10, "été ▁ <|endoftext|> 日本語 \x00 ok", "fr", "", 3, "q", "h"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
