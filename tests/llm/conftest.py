import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words int, `key` string, chunk long, fp string, item long, _id string"
SENTENCE = "the quick brown fox jumps over the lazy dog while seven bright stars watch from a very quiet northern sky"


def row(i, text, lang="en"):
    return (i, text, lang, None, None if text is None else len(text), 1, "k", 2, "f", 3, "x")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ties, and extra columns with names that operators use."""
    long = " ".join(f"word{i % 977} other{i % 31}" for i in range(60_000))
    lines = f"A common line that many documents share\n{SENTENCE}\n"
    rows = [
        row(1, None), row(2, ""), row(3, " \n\t "), row(4, long), row(5, SENTENCE * 3), row(5, SENTENCE * 3), row(6, SENTENCE * 3), row(7, lines + "one"),
        row(8, lines + "two"), row(9, lines + "three", None), row(None, SENTENCE), row(10, "12 34 !!", "de"), row(11, "é" * 50 + " ñandú", "es"), row(12, "word " * 200),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
