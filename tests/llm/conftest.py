import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls everywhere, empty and very long texts, repeats, and columns named like internal ones."""
    long_text = " ".join(f"word{i % 977} filler{i % 13}" for i in range(60_000))
    base = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 1),
        (2, "the QUICK brown fox jumps over the lazy dog", "en", "b", 1),
        (3, None, None, None, None),
        (4, "", "de", "a", 0),
        (None, "no id here", "fr", None, 3),
        (5, long_text, None, "c", 9),
        (6, "line one\nline two\n\nline three", "en", "b", 4),
        (6, "line one\nline two\n\nline three", "en", "b", 4),
        (7, "\u00e9\u4e16\u754c \U0001f600 \u00df\t\r\n x", "fr", "c", 2),
    ]
    df = spark.createDataFrame(base, DOC)
    return df.selectExpr("*", "1 as h", "'x' as row", "2 as cid", "3L as slot", "'s' as score", "0 as rk", "5 as `a.b`")


@pytest.fixture(scope="session")
def nothing(documents):
    return documents.limit(0)
