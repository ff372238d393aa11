import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows):
        made = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")

    return make
