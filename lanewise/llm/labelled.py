"""Bounded, reproducible samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import KEY


def remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the doc_id as text, modulo ``divisor``; a null doc_id is null."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def training_sample(docs: DataFrame, labels: DataFrame, target: str, allowed: Column, limit: int) -> DataFrame:
    """(row key, label): at most ``limit`` labelled rows of distinct doc_ids and texts, marked for broadcast.

    ``docs`` has doc_id, text and row key; only the rows of the keys returned are to be learnt from,
    however many others have their doc_ids.

    Rows come in the order of a hash of their doc_id, so the sample is the same at every run.
    Only ids that ``allowed`` admits are read; labels that contradict each other count as 1. Of
    equal texts only one is kept: a text copied a thousand times must not count a thousand
    times. The size is bounded by ``limit``, which is why both steps may broadcast.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & allowed)
    chosen = (
        usable.groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.col(target).cast("int")).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), *KEY)
    distinct = texts.join(F.broadcast(chosen), "doc_id").groupBy("hash").agg(F.min(F.struct("doc_id", "label", *KEY)).alias("one"))
    rows = distinct.groupBy("one.doc_id").agg(F.min(F.struct("hash", "one")).alias("first"))
    return F.broadcast(rows.select(*[f"first.one.{c}" for c in (*KEY, "label")]))
