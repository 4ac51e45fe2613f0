import pytest

AWKWARD = [
    (1, "the quick brown fox jumps over the lazy dog again and again", "a", "s1"),
    (2, "THE quick brown fox jumps over the lazy dog again and again", "a", "s1"),
    (3, None, None, None),
    (4, "", "a", ""),
    (5, "   \n\t ", "b", "s2"),
    (None, "a row without an id but with words in it", "b", "s2"),
    (6, "word", "b", "s2"),
    (6, "word", "b", "s2"),
    (7, "long " * 40_000, "a", "s1"),
    (8, "Ünïcödé ▁ 漢字 😀 text\x00with odd   characters", "b", "s3"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that results use."""
    rows = [(*r, 0.5, "x", True, 9, "y") for r in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, spans string, kept boolean, row_no int, recipe string")


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
