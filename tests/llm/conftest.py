import pytest

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, row int, hash string, term string, size string"


def rows(*pairs):
    """Documents with extra columns whose names the operators use themselves."""
    return [(i, t, None, "s", None if t is None else len(t), "k", 1, "h", "t", "z") for i, t in pairs]


@pytest.fixture
def documents(spark):
    def make(*pairs):
        return spark.createDataFrame(rows(*pairs), ODD)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, an empty text, a very long one, ties and repeated rows."""
    long = " ".join(f"word{i % 977} x{i % 13}" for i in range(20_000))
    return documents((1, None), (2, ""), (3, "One line.\nTwo lines!"), (3, "One line.\nTwo lines!"), (4, long), (None, "no id"), (5, "One line.\nTwo lines!"), (6, "<|endoftext|> déjà  vu 日本 \t\n 1²"))


@pytest.fixture
def empty(documents):
    return documents((1, "x")).where("doc_id < 0")
