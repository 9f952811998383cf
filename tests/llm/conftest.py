import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, n_tokens long, kept string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty texts, ties, repeated rows, long words, special strings, columns whose names clash with results."""
    texts = [None, "", " \n\t ", "one", "a b c", "A  B\nC", "x" * 5000, "<|endoftext|> a <|endoftext|>", "naïve Ünïcödé 東京 🙂   don't", "word " * 3000, "same text here " * 30, "same text here " * 30]
    rows = [(i, t, "en", "s", 1, 7, 7, "x") for i, t in enumerate(texts)] + [(3, "one", "en", "s", 1, 7, 7, "x"), (None, "nobody's text", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
