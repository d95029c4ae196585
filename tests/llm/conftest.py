import pytest


@pytest.fixture
def documents(spark):
    """Rows to a documents table; columns doc_id, text, lang, source, n_chars and one that clashes with working names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")

    return make


#: Edge texts that every operator meets.
EDGES = [(1, None, "a"), (2, "", None), (3, " \t\n\x0b\x0c\r", "a"), (4, "word", "b"), (5, "été 日本語 \U0001f600 x", "b"), (6, "a b c d e " * 20_000, "b"), (7, "same text here again and again", "a"), (8, "same text here again and again", "a"), (8, "same text here again and again", "a"), (None, "no id", None)]


@pytest.fixture
def edges(documents):
    return documents(EDGES)


@pytest.fixture
def write(spark, tmp_path):
    def put(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put
