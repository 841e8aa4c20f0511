import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame of texts (ids in order), or of (id, text, source) rows."""
    def make(texts, **extra):
        rows = [(i, t, "en", "a", 0) if not isinstance(t, tuple) else (t[0], t[1], "en", t[2], 0)
                for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)
    return make


#: nulls, empties, blanks, ties and repeated rows, a long text
ODD = [None, "", " \t\n\x0b\f\r ", "one", "one", "Ärger ß İ", "x" * 5000, "word " * 3000]
