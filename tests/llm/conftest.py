import pytest


@pytest.fixture(scope="module")
def hard(spark):
    """Documents with nulls, empty and long texts, ties, repeated rows, and columns whose names clash with results."""
    from tests_data import HARD

    return spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long, kept string, spans string, shard string")
