import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, words string"
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old farm house today again", "en"),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from the old farm house today again", "en"),
    (3, None, "en"), (4, "", "de"), (5, " \n\t ", None), (6, "12 34 !!", "en"), (7, "one", "en"), (8, LONG, "en"),
    (9, LONG + " tail", "en"), (10, "der hund und die katze sind im haus und schlafen nicht mehr so lange wie sonst immer", "de"),
    (10, "der hund und die katze sind im haus und schlafen nicht mehr so lange wie sonst immer", "de"),
    (None, "a text without a number that still has many words in it so that it is a real text after all", "en"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, lang, None, None, 5, 6, "x") for i, t, lang in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (7, 0, None), (10, None, 1)], "doc_id long, quality int, toxic int")
