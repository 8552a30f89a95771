import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A frame of (doc_id, text) rows with an extra column of a clashing name."""

    def build(rows, more="text_hash string"):
        return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {more}")

    return build
