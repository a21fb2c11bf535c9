import pytest


@pytest.fixture
def documents(spark):
    """Builds a documents table from (doc_id, text[, source]) with the other columns filled, and clashing extra ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "x", 7, "y") for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, size string, key int, row string").repartition(3)

    return make


@pytest.fixture
def by_id():
    def collect(frame, key="doc_id"):
        rows = [r.asDict() for r in frame.collect()]
        return sorted(rows, key=lambda r: (r[key] is None, r[key] if r[key] is not None else 0, repr(r)))

    return collect
