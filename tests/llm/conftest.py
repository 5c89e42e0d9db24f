import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with extra columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or ""), 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, DOCS + ", rid int, rest string, block int")

    return make
