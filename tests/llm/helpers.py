"""Fixtures shared by the training-data tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, spans string, _row string"


def docs(spark, texts, source="a", lang="en", start=0):
    """documents with extra columns whose names clash with result and helper columns."""
    rows = [(start + i, t, lang, source, None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, repeated ids."""
    long = " ".join(f"w{i % 97}" for i in range(30_000))
    rows = [(1, "one two three", "en", "a", 13, None, None, None), (1, "one two three", "en", "a", 13, None, None, None),
            (2, None, None, None, None, None, None, None), (3, "", "en", None, 0, "", "", ""), (4, " \t\n ", "fr", "b", 4, "1", "2", "3"),
            (None, "one two three", "en", "b", 13, None, None, None), (None, None, None, None, None, None, None, None),
            (5, long, "en", "b", len(long), "s", "s", "s"), (6, "x" * 50_000, "de", "c", 50_000, "s", "s", "s"), (7, "é 😀 ß one two three four", "de", "c", 24, "", "", "")]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def sentences(n, seed=0, vocabulary=30, least=0, most=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(least, most))) for _ in range(n)]


class Tables:
    """Stands in for a session where a query only reads tables: read.parquet(path) by file name."""

    def __init__(self, spark, **tables):
        self._tables, self._spark = tables, spark

    def __getattr__(self, name):
        return getattr(self._spark, name)

    @property
    def read(self):
        return self

    def parquet(self, path):
        return self._tables[path.rsplit("/", 1)[1].removesuffix(".parquet")]
