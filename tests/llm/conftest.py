import pytest


@pytest.fixture
def docs_of(spark):
    """Frame of documents from texts (or (doc_id, text) pairs), with extra columns whose names the operators use themselves."""

    def make(texts, clash=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        if not clash:
            return spark.createDataFrame(rows, "doc_id long, text string")
        return spark.createDataFrame([(*r, "s", 7, True) for r in rows], "doc_id long, text string, source string, node long, toxic boolean")

    return make
