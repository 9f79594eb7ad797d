import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns that clash with inner names."""

    def make(rows, clash=True):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if clash:
            for name in ("size", "score", "label", "print", "root", "first", "order", "number", "copies", "sha", "drop", "whole"):
                df = df.withColumn(name, F.lit("clash"))
        return df

    return make


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd_rows():
    """Nulls anywhere, empty and blank texts, ties, repeated rows, one very long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
    same = "One sentence of some words here. Another sentence with other words. And a third one to end it all, with a comma."
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\r\x0b\x0c"),
        (None, same),
        (4, same),
        (4, same),
        (5, same.upper()),
        (None, None),
        (6, "a"),
        (7, "ünï cødé ✓   text"),
        (8, long),
        (9, long + " tail"),
        (10, "a  b"),
        (11, "a b"),
    ]


def plain(rows):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in rows))
