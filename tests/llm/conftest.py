import duckdb
import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (id, text) pairs; lang, source and a clashing extra column come along."""

    def make(rows, **extra):
        full = [(i, t, "en", f"src{k % 2}", None if t is None else len(t), "mine", 7) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCUMENTS + ", row string, n_words int").repartition(3)

    return make


@pytest.fixture(scope="session")
def texts(folder):
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{folder}/documents.parquet' order by 1").fetchall()


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "a row without an id, long enough to be read"), (5, "same text " * 3000),
    (6, "same text " * 3000), (7, "Été à l'école naïve. \x0bΣΑΣ ß İ"), (8, "# * | < >\n# * | < >\n\n# * | < >"),
]


@pytest.fixture
def odd(docs):
    return docs(ODD)


@pytest.fixture
def empty(docs):
    return docs([(1, "x")]).filter("doc_id < 0")
