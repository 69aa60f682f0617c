import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, length int, label int, ids string, `run` int"
LONG = "lowly words roam here and there, as they do. " * 3000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, tied texts, columns with clashing names."""
    texts = [None, "", "   \n\t ", "one", "One two", "!!! ... 123", LONG, "漢字 và ça é", "same text here", "same text here", "a\x00b", "x" * 20000]
    rows = [(i, t, "en", "s", None, 0.5, 3, 1, "i", 2) for i, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
