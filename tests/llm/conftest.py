"""Small documents with every awkward case, and columns whose names clash with the operators' own."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, digest string, component string, n long, rest int"
LONG = "lorem ipsum dolor sit amet " * 4_000


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])."""
        full = [(*r, *(None,) * (4 - len(r)), 1, 9, "d", "c", 2, 3) for r in rows]
        frame = spark.createDataFrame(full, DOCS)
        return frame.repartition(3) if rows else frame

    return make


@pytest.fixture(scope="session")
def rows_of():
    def rows(frame):
        return sorted((tuple(r) for r in frame.collect()), key=repr)

    return rows
