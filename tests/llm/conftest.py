import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents-shaped table with an extra column whose name clashes with helpers'."""
    def make(rows):
        data = [(i, t, lang, "s", len(t or ""), "x") for i, t, lang in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    return make
