import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark, docs_schema):
    def make(*texts, sources=None, ids=None, **extra):
        rows = [(ids[i] if ids else i, t, "en", sources[i] if sources else "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, docs_schema)

    return make
