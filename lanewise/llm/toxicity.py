"""Toxic passages: maximal-scoring segments over token log-odds, calibrated as extreme values."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.labelled import remainder, training_sample
from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, text_batches, utf8
from lanewise.session import write_table

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6, 7)
CACHED_WORDS = 300_000
EULER = 0.5772156649015329
LIMIT = 16.0
_BINS, _BIN, _LOW = 80, 0.25, -4.0

FOLDS = 4
_FOLD = f"cast(pmod(xxhash64(doc_id, 'fold'), {FOLDS}) as int) AS fold"

_words = re.compile(r"\w+").findall


def words_of(text: bytes) -> list[str]:
    return _words(text.decode("utf-8", "replace").lower())


def units_of(word: str) -> list[int]:
    """Hash buckets of a token: the word itself and its beginnings, which catch inflected forms."""
    units, at, so_far = [], 0, 0
    for n in PREFIXES:  # each beginning goes on from the checksum of the shorter one
        if len(word) <= n:
            break
        so_far, at = crc32(word[at:n].encode(), so_far), n
        units.append((so_far ^ 0x5BD1E995) % BUCKETS)  # apart from the words of the same letters
    units.append(crc32(word[at:].encode(), so_far) % BUCKETS)
    return units


class WordScores(dict):
    """Word -> best log-odds of its units less the drift, computed once per word in a task."""

    def __init__(self, weights: np.ndarray, drift: float, cached: int = CACHED_WORDS):
        super().__init__()
        # Five single reads are far cheaper from an array than from an ndarray.
        self.weight_of, self.drift, self.cached = array("f", weights.tobytes()).__getitem__, drift, cached

    def __missing__(self, word: str) -> float:
        if len(self) >= self.cached:
            self.clear()
        score = self[word] = max(map(self.weight_of, units_of(word))) - self.drift
        return score


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, one past last, score), left to right, in linear time.

    Only positive tokens are visited; what lies between them is in the running sums. Each open
    segment links to the last one whose left sum is smaller, so no candidate is searched twice.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[tuple[int, int, float, float, int]] = []  # first, end, left sum, right sum, link
    for i in np.flatnonzero(scores > 0).tolist():
        first, left, right = i, float(sums[i]), float(sums[i + 1])
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= left:
                at = found[at][4]
            if at < 0 or found[at][3] >= right:
                found.append((first, i + 1, left, right, at))
                break
            first, _, left, _, link = found[at]
            del found[at:]
            at = link
    return [(first, end, right - left) for first, end, left, right, _ in found]


def fresh_scores(words: list[str], values: np.ndarray, segments: list[tuple[int, int, float]]) -> list[float]:
    """The segments' scores if each distinct word counts only once in the text.

    The weights come from counts of documents, so a word said again is no new evidence.
    """
    seen, again = set(), np.zeros(len(values), bool)
    for i in np.flatnonzero(values > 0).tolist():
        again[i] = words[i] in seen
        seen.add(words[i])
    sums = np.concatenate([[0.0], np.cumsum(np.where(again, 0.0, values))])
    return [float(sums[b] - sums[a]) for a, b, _ in segments]


def log_odds(toxic: Column, clean: Column, share: Column, sizes: tuple[int, int], strength: float, floor: float, caution: float) -> Column:
    """Log ratio of the shares of toxic and clean documents that have a unit.

    ``share`` is the unit's share of all documents, ``sizes`` are the toxic and clean documents
    counted. The prior is worth ``strength`` documents in which units are as common as in the
    corpus, ``floor`` at least; the ratio is drawn to zero by ``caution`` standard errors.
    """
    prior = F.greatest(share * strength, F.lit(floor))
    a, b = toxic + prior, clean + prior
    delta = F.log(a / (sizes[0] + strength)) - F.log(b / (sizes[1] + strength))
    return F.signum(delta) * F.greatest(F.abs(delta) - caution * F.sqrt(1 / a + 1 / b), F.lit(0.0))


@dataclass
class Toxicity:
    """Unit log-odds, the extreme-value constants of clean text, and the final logistic curve."""

    weights: np.ndarray
    drift: float
    rate: float  # lambda
    scale: float  # K
    intercept: float = -3.0
    slope: float = 1.0

    def bits(self, scores: list[float], words: int) -> list[float]:
        """Normalised scores: ln of 1 over the expected number of such segments in clean text."""
        chance = math.log(self.scale * max(words, 1))
        return [self.rate * s - chance for s in scores]

    def evidence(self, scores: list[float], words: int) -> float:
        """Sum over the segments rarer than chance; without any, the best one's (negative) value.

        Held within LIMIT: beyond it nothing becomes surer, and a few odd texts or wrong labels
        can't bend the curve that is fitted to it.
        """
        each = self.bits(scores or [0.0], words)
        return min(max(sum(x for x in each if x > 0) or max(each), -LIMIT), LIMIT)

    def probability(self, evidence):
        return 1 / (1 + np.exp(-(self.intercept + self.slope * np.asarray(evidence))))


def _solve_rate(share: np.ndarray, value: np.ndarray) -> float:
    """The positive root of sum share * exp(rate * value) = 1."""
    if not (share[value > 0] > 0).any() or (share * value).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    total = lambda r: float((share * np.exp(np.minimum(r * value, 700))).sum())
    while total(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(high, 0.05)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Newton's method for one feature with an intercept."""
    beta = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), 0.1])
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        gradient = design.T @ (y - p) - ridge * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), max(float(beta[1]), 0.0)


def unit_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Per bucket: documents with the unit in all of ``docs``, and in each class and fold of the sample; stored.

    Bucket BUCKETS counts the documents themselves. A corpus document counts once for each of
    its distinct words. Every text is read; a task sends a line for each bucket it met.
    """
    names = ["corpus", *(f"{c}{f}" for f in range(FOLDS) for c in ("clean", "toxic"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus, classes = np.zeros(BUCKETS + 1, np.int64), np.zeros((2 * FOLDS, BUCKETS + 1), np.int32)
        met: Counter = Counter()
        for batch in batches:
            for text, label, fold in zip(utf8(batch["text"]), batch["label"].to_pylist(), batch["fold"].to_pylist()):
                words = set(words_of(text))
                met.update(words)
                if label is not None:
                    classes[2 * fold + label][list({u for w in words for u in units_of(w)} | {BUCKETS})] += 1
                if len(met) > CACHED_WORDS:
                    _add(corpus, met)
            corpus[BUCKETS] += batch.num_rows
        _add(corpus, met)
        at = np.flatnonzero(corpus)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(x[at]) for x in (corpus, *classes))], ["bucket", *names])

    labelled = docs.join(sample, KEY, "left").selectExpr("text", "label", _FOLD)
    kinds = ", ".join(f"{n} {'int' if n[-1].isdigit() else 'long'}" for n in names)
    return write_table(labelled.mapInArrow(run, f"bucket int, {kinds}").groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]), "units")


def _add(corpus: np.ndarray, met: Counter) -> None:
    units, counts = [], []
    for word, n in met.items():
        own = units_of(word)
        units += own
        counts += [n] * len(own)
    if units:
        corpus += np.bincount(units, weights=counts, minlength=BUCKETS + 1).astype(np.int64)
    met.clear()


def fit(
    docs: DataFrame,
    labels: DataFrame,
    limit: int = 20_000,
    strength: float = 10.0,
    floor: float = 1.0,
    caution: float = 2.0,
    drift: float = 0.3,
) -> Toxicity:
    """Learn from at most ``limit`` labelled rows whose crc32(doc_id) mod 3 is not 1.

    The prior counts all of ``docs``. For the calibration each fold of the sample is scored
    with what the other folds have taught, so that evidence is as strong as on unseen texts.
    Rate and scale are those of the clean texts: rate * score - ln(scale * words) is the log
    rarity of a segment. Without labels of both classes in two folds nothing is known: no unit
    has weight and every text gets the same low score.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    sample = training_sample(slim, labels, "toxic", remainder("doc_id", 3) != 1, limit)
    counts = unit_counts(slim, sample)
    of = lambda kind, out: [f"{kind}{f}" for f in range(FOLDS) if f != out]
    totals = counts.where(F.col("bucket") == BUCKETS).first()
    model = Toxicity(np.zeros(BUCKETS, np.float32), drift, 1.0, 1.0)
    if totals is None or min(sum(totals[c] > 0 for c in of(kind, None)) for kind in ("toxic", "clean")) < 2:
        return model
    learnt = []
    for out in (None, *range(FOLDS)):
        toxic, clean = of("toxic", out), of("clean", out)
        sizes = tuple(sum(totals[c] for c in side) for side in (toxic, clean))
        count = lambda side: F.expr(" + ".join(side))
        odds = log_odds(count(toxic), count(clean), F.col("corpus") / totals["corpus"], sizes, strength, floor, caution)
        learnt.append(odds.cast("float").alias(f"w{len(learnt)}"))
    # Most units say nothing; the driver gets the others, BUCKETS lines at most.
    weights = counts.where(F.col("bucket") < BUCKETS).select("bucket", *learnt)
    weights = weights.where(" OR ".join(f"w{i} <> 0" for i in range(len(learnt)))).toArrow()
    dense = np.zeros((len(learnt), BUCKETS), np.float32)
    dense[:, weights["bucket"].to_numpy()] = np.stack([weights[f"w{i}"].to_numpy() for i in range(len(learnt))])
    model.weights = dense[0].copy()
    shared = docs.sparkSession.sparkContext.broadcast(dense[1:])
    doubles = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_fold = [WordScores(w, drift, CACHED_WORDS // FOLDS) for w in shared.value]
        for batch in batches:
            out, count, total = [], np.zeros(_BINS), np.zeros(_BINS)
            for text, label, fold in zip(utf8(batch["text"]), batch["label"].to_pylist(), batch["fold"].to_pylist()):
                words = words_of(text)
                values = np.array([of_fold[fold][w] for w in words], float)
                if label == 0:
                    bins = np.clip(((values - _LOW) / _BIN).round().astype(int), 0, _BINS - 1)
                    count += np.bincount(bins, minlength=_BINS)
                    total += np.bincount(bins, weights=values, minlength=_BINS)
                own = fresh_scores(words, values, maximal_segments(values))
                out.append({"label": label, "words": len(values), "segments": [float(s) for s in own]})
            out.append({"count": count.tolist(), "sum": total.tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("label", pa.int32()), ("words", pa.int64()), ("segments", doubles), ("count", doubles), ("sum", doubles)]))

    seen = slim.join(sample, KEY).selectExpr("text", "label", _FOLD)
    seen = write_table(seen.mapInArrow(run, "label int, words long, segments array<double>, count array<double>, sum array<double>"), "segments")
    bins, seen = seen.where("label IS NULL").select("count", "sum").collect(), seen.where("label IS NOT NULL")
    share, value = (np.sum([r[c] for r in bins], axis=0) for c in ("count", "sum"))
    model.rate = _solve_rate(share / max(share.sum(), 1), value / np.maximum(share, 1))
    clean = seen.where("label = 0").select(F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("top"), "words").toArrow()
    top, size = clean["top"].to_numpy(), np.maximum(clean["words"].to_numpy(), 1)
    model.scale = float(np.exp(np.mean(model.rate * top - np.log(size)) - EULER))
    constants = vars(model) | {"weights": None}

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Toxicity(**constants)
        for batch in batches:
            found = [own.evidence(s, n) for s, n in zip(batch["segments"].to_pylist(), batch["words"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(found, pa.float64())], ["label", "evidence"])

    # One line for each row of the sample; all segments of a text count, as they do in ``scores``.
    points = seen.select("label", "words", "segments").mapInArrow(weigh, "label int, evidence double").toArrow()
    model.intercept, model.slope = _logistic(points["evidence"].to_numpy(), points["label"].to_numpy().astype(float))
    return model


def scores(docs: DataFrame, model: Toxicity, rare: float = 0.01) -> DataFrame:
    """(doc_id, row key, score, passages) of every whole text.

    score is the calibrated probability in [0, 1]; passages lists each segment of which clean
    text of that length holds fewer than ``rare``, as first word, one past the last, score and
    that expected number. Null and empty texts have no passage and the score of no evidence.
    Extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    passage = "array<struct<first:int,last:int,score:double,expected:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    least = -math.log(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Toxicity(**shared.value)
        values_of = WordScores(model.weights, model.drift)
        for batch in batches:
            evidence, passages = [], []
            for text in utf8(batch["text"]):
                words = words_of(text)
                values = np.array([values_of[w] for w in words], float)
                segments = maximal_segments(values)
                evidence.append(model.evidence(fresh_scores(words, values, segments), len(values)))
                rarity = model.bits([s for _, _, s in segments], len(values))
                passages.append([{"first": a, "last": b, "score": s, "expected": math.exp(-x)} for (a, b, s), x in zip(segments, rarity) if x > least])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch[FILE], batch[ROW], pa.array(model.probability(np.array(evidence)).astype(float)), pa.array(passages, kind)],
                ["doc_id", *KEY, "score", "passages"],
            )

    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, score double, passages {passage}")


def toxic_rows(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The contract's columns and the number of significant passages; held_out is null for a null doc_id."""
    return scores(docs, fit(docs, labels)).select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        F.size("passages").alias("passages"),
    )


def rejected(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """Row keys of the documents to drop, stored."""
    with text_batches(docs.sparkSession):
        return write_table(scores(docs, fit(docs, labels)).where(F.col("score") >= cut).select(*KEY), "toxic")


ship(__name__)
