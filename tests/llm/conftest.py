import pytest


@pytest.fixture
def docs(spark):
    """Make a documents table of (doc_id, text) pairs with clashing extra columns."""

    def make(rows):
        schema = "doc_id long, text string, key long, print string, line int, words string, row string, n long, lang string, source string, n_chars long"
        return spark.createDataFrame([(i, t, 7, "p", 1, "w", "r", 3, None, None, None) for i, t in rows], schema)

    return make
