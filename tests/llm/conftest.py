import pytest


@pytest.fixture
def corpus(spark):
    """Small documents: nulls, empty and blank texts, repeats, near copies, a long text, columns with names used inside."""
    def make(rows):
        full = [(i, t, lang, source, 0 if t is None else len(t), 7, "x") for i, t, lang, source in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, score int, id string")
    return make
