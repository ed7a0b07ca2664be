import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, k long, part string"


@pytest.fixture(scope="session")
def docs(spark):
    """Hard rows: nulls everywhere, empty and blank texts, ties, repeated rows, a very long text, columns whose names clash."""

    def make(texts, first=0, source="s"):
        rows = [(first + i, t, "en", source, len(t or ""), 0.5, 1, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def hard(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, None, None, None), (2, "", "en", "a", 0, 1.0, 1, "p"), (3, " \n\t ", "en", "a", 3, 1.0, 1, "p"), (4, "one two", "en", "b", 7, 1.0, 1, "p"),
        (5, "One TWO three four five six seven", "en", "b", 33, 1.0, 1, "p"), (5, "One TWO three four five six seven", "en", "b", 33, 1.0, 1, "p"), (6, "one two three four five six seven", None, None, 33, 1.0, 1, "p"),
        (7, long, "en", "c", len(long), 1.0, 1, "p"), (8, long, "en", "c", len(long), 1.0, 1, "p"), (None, "lone row without id", "en", "c", 19, 1.0, 1, "p"), (9, "日本語 🤖 é" * 50, "ja", "d", 450, 1.0, 1, "p"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
