import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty and white-space texts, ties, repeated rows, a long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "one two"), (6, "one two"),
    (7, "The quick brown fox jumps over the lazy dog " * 3), (8, "the QUICK brown fox jumps over the lazy dog " * 3),
    (9, "wörter über größe ÀÉ   x y " * 20), (10, "ab " * 20_000), (11, "z" * 50_000), (12, "<|endoftext|> it's    12345 \U0001f600"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The awkward documents, with further columns whose names clash with results."""
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 5, 7.0) for i, t in AWKWARD]
    return spark.createDataFrame(rows, DOCS + ", component_id string, fp int, hash double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def benchmark_rows(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
