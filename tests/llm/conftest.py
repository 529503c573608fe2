import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents of (doc_id, text) or (doc_id, text, source), with columns whose names the operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 0.5) for r in rows]
        return spark.createDataFrame(full, f"{DOCUMENTS}, t int, node string, toxic_score double")

    return make
