import pytest

#: Null and empty texts, a very long one, repeated rows, ties, and columns whose names operators use themselves.
TEXTS = [None, "", " \t\n ", "one", "a b c " * 9000, "The cat sat on the mat and it was there for all of us to see in the light of day.", "The cat sat on the mat and it was there for all of us to see in the light of day.", "x" * 5000, "Zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich und das ist gut."]


@pytest.fixture(scope="session")
def edge(spark):
    rows = [(i, t, "en", "s1" if i % 2 else None, None, "k", 1.0, i) for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id here", None, None, None, "k", 1.0, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, w double, rank int")


@pytest.fixture(scope="session")
def empty(spark, edge):
    return spark.createDataFrame([], edge.schema)
