import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, component string, line string"


@pytest.fixture
def docs(spark):
    """Documents with two or four given columns, and extra columns that clash with inner names."""

    def make(*rows):
        full = [
            (i, t, *(r or (None, None)), None if t is None else len(t), 7, "extra", "extra")
            for i, t, *r in rows
        ]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
