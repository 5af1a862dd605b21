import pytest


@pytest.fixture
def docs_of(spark):
    """Documents from texts, with an extra column whose name clashes with names that operators use."""

    def make(texts, first_id=0, **columns):
        rows = [(first_id + i, t, "en", f"host{i % 3}", None if t is None else len(t), "kept") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
        return df.withColumns(columns) if columns else df

    return make
