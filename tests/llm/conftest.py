import pytest

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, recipe string, score double, kept boolean, root long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with those of the operators."""
    from bizlens.llm.common import ship

    ship(spark)
    return lambda pairs: spark.createDataFrame([(i, t, "xx", "r", 0.5, True, 3) for i, t in pairs], DOCS)


ODD = [
    (1, None), (2, ""), (3, "a"), (4, "  \t\n "), (5, "The  cat\nsat on the mat."), (6, "The cat sat on\tthe mat."), (7, "é" * 300),
    (8, "ab" * 3000), (9, "x" * 9000), (10, "A b c d e f g h"), (10, "A b c d e f g h"), (10, "another text of the same id"), (None, "no id"), (None, "no id"),
    (11, "<|endoftext|> in a text's words, 123 and 4567"), (12, "日本語 の 文章 です " * 40), (13, "ź é ẞ İ Σ"), (-5, "The cat sat on the mat."),
]
