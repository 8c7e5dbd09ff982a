import pytest

from deltaboard.session import Staging

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string, label int"


@pytest.fixture
def stage(spark, tmp_path):
    made = Staging(spark, str(tmp_path))
    yield made
    made.close()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    long_text = " ".join(f"wort{k % 977}x{k % 31}" for k in range(30_000))
    copy = "a passage that several documents share " * 6
    rows = [
        (1, copy, "en", "h", 1, "x", 1), (1, copy, "en", "h", 1, "x", 1), (2, copy, None, None, None, None, None),
        (3, "", "en", "h", 0, "x", 1), (4, None, "en", "h", 0, "x", 1), (None, copy + "end", "de", "h", 1, "x", 1),
        (None, None, None, None, None, None, None), (5, long_text, "de", "h", 1, "x", 1), (6, " \n\t ", "de", "g", 1, "x", 1),
        (7, "x" * 50_000, "en", "g", 1, "x", 1), (8, "été – 漢字 \U0001f600 ok", "fr", "g", 1, "x", 1),
        (9, copy[:-1], "en", "g", 1, "x", 1), (5, "another text of the same id", "en", "g", 1, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)
