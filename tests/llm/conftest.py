import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """make(rows) -> documents with an extra column whose name clashes with inner ones."""

    def make(rows, more=""):
        return spark.createDataFrame([(*r, *(["x"] if not more else [])) for r in rows], f"doc_id long, text string{', ' + more if more else ', id string'}")

    return make
