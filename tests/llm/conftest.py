import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Nulls, empty and blank texts, repeated rows and ids, a very long text.
ROWS = [
    (1, "a b c d e f", "s1", "en"),
    (2, "a b c d e f", "s1", "en"),
    (2, "a b c d e f", "s1", "en"),
    (3, None, "s2", None),
    (4, "", "s2", "fr"),
    (5, " \n\t ", None, "fr"),
    (None, "x y z", None, "de"),
    (None, "x y z", None, "de"),
    (None, None, None, None),
    (6, "Hélas! ÇA 漢字 😀 A-Z", "s1", "fr"),
    (7, "long " * 60_000, "s3", "en"),
    (8, "word", "s3", "en"),
]
#: Names that operators might give columns of their own.
CLASHES = ("score", "fp", "row", "key", "size", "part", "text_hash", "label", "n", "taken")


@pytest.fixture(autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="session")
def odd_docs(spark):
    """The odd rows, with columns that clash with those of operators."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    rows = [r + (f"{i}",) * len(CLASHES) for i, r in enumerate(ROWS)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, lang string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(9)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
