import pytest

SCHEMA = "doc_id long, text string, lang string, source string, kept string, score string, __lg_text2 string"


@pytest.fixture
def docs_of(spark):
    """A documents table with extra columns whose names clash with results, over two partitions."""

    def make(rows):
        rows = [(*r, None, None, None)[:7] if len(r) == 4 else r for r in rows]
        return spark.createDataFrame([(*r[:4], "k", "s", "t") for r in rows], SCHEMA).repartition(2)

    return make


LONG = " ".join(f"word{k}" for k in range(30_000))
EDGE = [
    (1, None, None, None), (2, "", "en", "a"), (3, "", None, "a"), (4, "   \n\t ", "en", None), (5, "Same Text here", "en", "a"), (6, "same text HERE", "de", "b"),
    (7, "sAME tEXT hERE", None, "b"), (8, LONG, "en", "a"), (None, "no id", "en", "a"), (9, "É É é", "fr", "c"), (10, "é é é", "fr", "c"),
    (11, "twice", "en", "a"), (11, "twice", "en", "a"),
]


@pytest.fixture
def edge_docs(docs_of):
    return docs_of(EDGE)


@pytest.fixture
def empty_docs(docs_of):
    return docs_of([])
