import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, block string, key int, n int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names clash with those that operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "b", 2, 3) for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd(frame):
    """Null and empty texts, repeated rows, a null id and source, a very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two three four five six", None), (3, "one two three four five six", None), (None, "seven eight nine", "b"), (5, long, "b"), (6, " \n\t ", "b"), (7, "x", "a")]
    return frame(rows)
