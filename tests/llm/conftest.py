import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text[, lang, source]) rows, with extra columns whose names clash with results."""

    def make(rows, **extra):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None, "x", 7, True) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, kept boolean")

    return make


