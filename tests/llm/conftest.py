import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with odd rows, an extra column and columns whose names the operators use themselves."""

    def make(rows):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, node int, rec string, size int, label string"
        full = [(i, t, lang, src, len(t or ""), 1, "x", 2, "y") for i, t, lang, src in rows]
        return spark.createDataFrame(full, schema)

    return make
