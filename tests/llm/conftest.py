import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from texts (ids from 0) or from (id, text) pairs."""

    def make(texts, lang="en"):
        pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
