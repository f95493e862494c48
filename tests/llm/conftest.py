import pytest

from helpers import DATA


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text) rows, with columns that clash with the operators' own names."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "clash") for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score string")

    return make


@pytest.fixture
def sf_dir():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)
