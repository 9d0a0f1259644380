import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (id, text) pairs, with columns whose names operators use
    themselves."""

    def make(pairs, lang="en"):
        rows = [(i, t, lang, "s", len(t or ""), 1, "x", 2, 3) for i, t in pairs]
        extra = ", n_words int, _id string, _hash int, `component_id` int"
        return spark.createDataFrame(rows, SCHEMA + extra).repartition(3)

    return make
