import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, wordless and very long texts, repeated rows, and columns whose names clash with inner ones."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (1, None, None, None, None, "a"), (None, "some text without an id", "en", "s", 1, "b"), (2, "", "en", None, 0, "c"), (3, "--- ... !!!", None, "s", 11, "d"),
        (4, long, "en", "s", len(long), "e"), (5, "one two three", "en", "s", 13, "f"), (5, "one two three", "en", "s", 13, "f"), (6, "One  two\tthree", "de", "s", 14, "g"),
        (7, "Ünïcödé Wörter – 中文 текст 😀", "de", "s", 26, "h"), (None, None, None, None, None, None), (8, long, "en", "t", len(long), "i"), (9, "\n\n \t", "fr", "s", 4, "j"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string").selectExpr(
        "*", "1 as comp", "2 as sig", "3 as a", "4 as b", "5 as shard", "6 as score", "7 as grp", "8 as size")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
