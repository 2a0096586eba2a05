import pytest


@pytest.fixture
def docs(spark):
    """Makes documents of (doc_id, text, lang, source), with a column whose name a careless operator would use itself."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, size long, token string, p struct<x:int>"
        return spark.createDataFrame([(*r, len(r[1] or ""), -1, "x", None) for r in rows], schema)

    return make


def odd_rows():
    """Nulls in every column, empty and white texts, a long text, ties and repeated rows."""
    long = " ".join(f"word{i % 997} of{i % 31}" for i in range(6000))
    text = "The quick brown fox jumps over the lazy dog and then runs far away from the angry farmer who owns it."
    return [
        (1, text, "en", "a"), (2, text, "en", "b"), (2, text, "en", "b"), (3, None, "en", "a"), (4, "", None, "a"), (5, " \t\n ", "de", None),
        (None, text, None, None), (None, None, None, None), (6, long, "en", "a"), (7, "x", "de", "c"), (8, "two words", "de", "c"),
        (9, "Füße über Öl und Ähnliches € 😀 naïve", "de", "b"), (10, "12345 67890 !!! ???", "en", "b"), (11, text.upper(), "en", "a"),
    ]


@pytest.fixture
def odd():
    return odd_rows()
