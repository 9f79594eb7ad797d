"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.labelled import remainder, training_sample
from lanewise.llm.rows import KEY, keyed, ship, utf8

DIMENSIONS = 1 << 18
_tokens = re.compile(r"\w+|[^\w\s]+").findall


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector of a whole text: hashed word and word-pair counts, damped, of length 1.

    Words are runs of letters and digits; runs of other marks are words too. The first index
    is the constant.
    """
    words = _tokens(text.decode("utf-8", "replace").lower())
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    one = np.fromiter((crc32(w.encode()) for w in words), np.uint64, len(words))
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]  # Fixed value: the 64-bit golden ratio.
    hashed = np.concatenate([one, two ^ (two >> np.uint64(32))]) % np.uint64(DIMENSIONS - 1) + np.uint64(1)
    at, count = np.unique(hashed.astype(np.int64), return_counts=True)
    value = 1 + np.log(count)
    return np.concatenate([[0], at]), np.concatenate([[1.0], value / np.sqrt((value * value).sum())])


@dataclass
class Leader:
    """FTRL-Proximal state: z, n for each coordinate; weights follow from them."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1

    def __post_init__(self):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (probability(w @ value) - label) * value
        squares = gradient * gradient
        sigma = (np.sqrt(self.n[at] + squares) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += squares


def probability(margin):
    return 1 / (1 + np.exp(-np.clip(margin, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, limit: int = 12_000, epochs: int = 4) -> np.ndarray:
    """Weights (float32) learnt from at most ``limit`` labelled rows whose crc32(doc_id) mod 5 is not 0.

    Vectors are made where the texts lie. The updates are a sequence, so one task takes the
    bounded sample, ``epochs`` times, in the order of a hash of (epoch, doc_id): the same at
    every run. It reads a stream and holds the model only. The driver gets DIMENSIONS numbers.
    Without labels all weights are 0, and every score is a half.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    sample = training_sample(slim, labels, "quality", remainder("doc_id", 5) != 0, limit)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["label"], pa.array([a.astype(np.int32).tobytes() for a, _ in made], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary())],
                ["doc_id", "label", "at", "value"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader = Leader()
        for batch in batches:
            for at, value, label in zip(utf8(batch["at"]), utf8(batch["value"]), batch["label"].to_pylist()):
                leader.learn(np.frombuffer(at, np.int32), np.frombuffer(value, np.float32).astype(float), float(label))
        yield pa.RecordBatch.from_arrays([pa.array([leader.weights().astype(np.float32).tobytes()], pa.binary())], ["weights"])

    rows = slim.join(sample, KEY).select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, at binary, value binary")
    passes = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("order", F.xxhash64("epoch", "doc_id"))
    sequence = passes.repartition(1).sortWithinPartitions("epoch", "order", "doc_id").select("label", "at", "value")
    learnt = sequence.mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(learnt[0][0], np.float32) if learnt else np.zeros(DIMENSIONS, np.float32)


def scores(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text, as a sparse dot product.

    Null and empty texts get the score of the constant. Extra columns are ignored; repeated
    rows are scored each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [float(shared.value[at] @ value) for at, value in map(features, utf8(batch["text"]))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(probability(np.array(margins, float)))], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def quality_rows(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """The contract's columns; held_out is null for a null doc_id."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


ship(__name__)
