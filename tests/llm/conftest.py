from __future__ import annotations

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, copies, near copies and repeated rows."""
    base = " ".join(f"word{i}" for i in range(120))
    near = base.replace("word60", "other")
    long = " ".join(f"l{i % 7000}x{i % 13}" for i in range(9000))
    french = "élan été où être une rue à côté du château " * 6
    rows = [
        (1, base, "en", "a"), (2, near, "en", "a"), (3, base, "en", "b"), (4, None, "en", "b"), (5, "", "fr", None), (6, " \n\t ", None, "c"), (7, long, "en", "a"), (8, french, "fr", "d"), (9, "one two three", "en", "d"),
        (10, "one two three", None, "e"), (None, base + " tail", "en", "a"), (11, "prefix here " + base, "en", None), (11, "prefix here " + base, "en", None), (12, "###" * 200, "en", "a"), (13, "a\nb\na\nb\na", None, "a"),
        (14, "same eight words in a row here now " * 9, "en", "a"), (15, "\u3000ünï\u00a0cödé \x1c sep", "de", "z\u00e9"), (16, "<|endoftext|> kept as is <|endoftext|>", "en", "a"),
    ]
    return [(*r, None if r[1] is None else len(r[1])) for r in rows]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, COLUMNS).repartition(3)
    extra = {"host": F.lit("x"), "node": F.lit(1), "size": F.lit(2), "words": F.lit("w"), "score": F.lit("s"), "first": F.lit(None).cast("string")}
    return df.withColumns(extra).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
