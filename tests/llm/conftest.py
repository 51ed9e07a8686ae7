import os

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, spans string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts or (id, text, lang), with columns whose names clash with results."""
    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r, "en") for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, f"src{(i or 0) % 3}", len(t or ""), False, "x") for i, t, lang in rows], DOCS)
    return make


@pytest.fixture(scope="session")
def sample(sf_small):
    import duckdb
    assert os.path.exists(sf_small)
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{sf_small}/documents.parquet' ORDER BY doc_id").fetchall()
