import pytest

from tests.conftest import spark  # noqa: F401

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):  # noqa: F811
    def make(rows):
        """Documents from (id, text) pairs, with columns that clash with inner names."""
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, "x") for i, t in rows], DOCS + ", fp int, key string")
        return df
    return make
