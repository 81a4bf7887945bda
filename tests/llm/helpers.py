"""Small tables and checks that the tests of the corpus operators share."""

from pyspark.sql import DataFrame

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, source="s", lang="en") -> DataFrame:
    """Documents 0, 1, ... of ``texts``; a (doc_id, text) pair gives its own number."""
    rows = []
    for i, text in enumerate(texts):
        doc_id, text = text if isinstance(text, tuple) else (i, text)
        rows.append((doc_id, text, lang, source, None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCS)


def odd(spark) -> DataFrame:
    """Nulls, empty, blank and very long texts, repeated rows and columns with clashing names."""
    long = "word " * 60_000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (None, "Text without a number here", "en", None, 26),
        (4, long, "en", "b", len(long)),
        (5, "Same text, twice over", "de", "b", 21),
        (5, "Same text, twice over", "de", "b", 21),
        (6, "same TEXT, twice over", "de", "b", 21),
    ]
    extra = "words bigint, key string, fp bigint, root bigint, lines string, ids string, doc string"
    return spark.createDataFrame([(*r, 1, "k", 2, 3, "l", "i", "d") for r in rows], f"{DOCS}, {extra}")


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
