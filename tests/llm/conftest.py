import pytest


@pytest.fixture()
def documents(spark):
    """Documents from (id, text) or (id, text, lang, source), with extra columns whose names clash with inner ones."""

    def make(*rows):
        rows = [(*r, *("en", "s")[len(r) - 2 :], 0, "x", 1.5, -1) for r in rows]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard string, score double, __text int")

    return make
