import pytest


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    rows = [
        (1, "the same text", "x"), (2, "the  same\ttext", None), (2, "the  same\ttext", None), (3, None, "x"), (4, "", "y"), (None, "the same text", "y"),
        (None, None, None), (5, " \n\t ", "z"), (6, "word " * 20000, "z"), (7, "word " * 20000 + "end", "z"), (8, "äöü 日本 😀", "z"), (9, "a\x00b   c", "z"),
        (10, "one two three four", "z"), (11, "ONE TWO THREE FOUR", "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string")
    return df.selectExpr(
        "doc_id", "text", "id", "'a' AS row_id", "1 AS digest", "2 AS fp", "3 AS h", "4 AS words", "5 AS n", "6 AS kept", "7 AS key", "8 AS page_id", "9 AS score", "10 AS th"
    )


@pytest.fixture
def empty(awkward):
    return awkward.limit(0)
