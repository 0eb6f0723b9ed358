import pytest

WORDS = "the of and river stone light winter garden house paper silver morning window letter bridge forest".split()


@pytest.fixture(scope="session")
def make(spark):
    """A documents table of (doc_id, text) rows, with columns whose names clash with those of the operators."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], "doc_id bigint, text string, lang string, fp int, x string")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, repeated rows, ties, a long text and a long word."""
    long = " ".join(WORDS[(i * 7) % 16] + str(i % 13) for i in range(3000))
    return [(1, None), (2, ""), (3, "  \n "), (4, "Hello there World again"), (5, "hello there world AGAIN"), (5, "hello there world AGAIN"), (None, "no id at all here"), (6, long), (7, "é" + "a" * 5000), (8, "😀 中文 text x"), (9, long + " end")]
