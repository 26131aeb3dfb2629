import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table and clashing extra ones."""
    def make(rows):
        full = [(i, t, "en", "s0", None if t is None else len(t), "x", 7) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, "
                                           "n_tokens string, score int").repartition(3)
    return make


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "straße — naïve 日本語 ▁ a  b\tc\x00d"), (6, "word " * 30000),
       (7, "long" * 40000), (8, "x"), (9, "😀" * 50), (9, "twice"), (9, "twice"), (None, "no id"), (None, None)]


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must stand: nulls, empty, very long, tied and repeated ones."""
    return ODD
