import pytest

from tidemark.session import send_package

LONG = " ".join(f"word{k % 977}x{k}" for k in range(40_000))


@pytest.fixture(scope="session")
def sent(spark):
    """The session, with the package on its Python workers."""
    return send_package(spark)


@pytest.fixture
def odd_documents(sent):
    """Nulls in all columns, empty and very long texts, repeated rows, columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", None, 1, "x"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", None, 1, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 2, "y"),
        (None, "one two", "en", None, 7, 3, "z"),
        (4, "one two", None, "b", 7, 4, "z"),
        (5, "  \n\t ", "de", "b", 5, 5, ""),
        (6, "12 345 -- !!", "de", "b", 12, 6, ""),
        (7, LONG, "en", "a", len(LONG), 7, "long"),
        (8, LONG + " tail", "en", "c", len(LONG) + 5, 8, "long"),
        (9, "Größe über alles 🎉 naïve ñandú", "de", "c", 31, 9, "u"),
        (4, "something else entirely here", "en", "b", 28, 10, "again"),
    ]
    return sent.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, key string")


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.filter("false")
