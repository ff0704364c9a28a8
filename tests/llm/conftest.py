import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text[, lang[, source]]) rows, with extra columns
    whose names the operators also use."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s",
                 len(r[1] or ""), "x", 7, True) for r in rows]
        return spark.createDataFrame(full, DOC_SCHEMA + ", keep_id string, size int, kept boolean")
    return make


@pytest.fixture
def as_rows():
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
