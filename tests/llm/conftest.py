import pytest

pytest.importorskip("tessera.llm")

SF = "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    """A DataFrame from rows and a schema."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(frame):
    """``documents`` from texts or (id, text) or (id, text, source)."""
    def make(items):
        rows = []
        for i, x in enumerate(items):
            x = x if isinstance(x, tuple) else (i, x)
            rows.append((x[0], x[1], "en", x[2] if len(x) > 2 else "s", len(x[1] or "")))
        return frame(rows, DOCS)
    return make
