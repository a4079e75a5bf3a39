import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _copies string, _row string, kept string, fp string"


def rows(*texts, source="s", start=0):
    """Documents with extra columns whose names the operators use themselves."""
    return [(start + i, t, "en", source, len(t or ""), "x", "y", "z", "k", "f") for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    def make(data):
        return spark.createDataFrame(data, SCHEMA)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a very long text, and other scripts.
AWKWARD = [None, "", " \t\n", "a", "a", "b  c", "b c", "b c", "x" * 200_000, "wörd " * 30_000, "日本語 テキスト", "😀 é\x1d\x1e"]


@pytest.fixture
def awkward(docs):
    data = rows(*AWKWARD)
    data += [data[3], (None, None, None, None, None, None, None, None, None, None), (None, "a", "en", None, 1, "x", "y", "z", "k", "f")]
    return docs(data)


@pytest.fixture
def empty(docs):
    return docs([])
