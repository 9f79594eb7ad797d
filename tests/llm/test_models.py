"""Toxicity, quality, decontamination: kernels against plain Python, learnt models on held-out rows."""

import numpy as np
import pytest
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewise.llm import decontaminate, quality, toxicity
from lanewise.llm.labelled import remainder, training_sample
from lanewise.llm.rows import KEY, keyed

BIG = "/root/testdata/sf0.1"


def slow_segments(scores):
    """Maximal segments by definition: take the best (shortest, first) one, then both sides."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2]):
                best = (i, j + 1, total)
    if best is None:
        return []
    i, j, _ = best
    left, right = slow_segments(scores[:i]), slow_segments(scores[j:])
    return left + [best] + [(a + j, b + j, s) for a, b, s in right]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-4, 4).map(lambda x: x * 1.25 + 0.01 * (x > 0)), max_size=24))
def test_maximal_segments(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in slow_segments(scores)))
    assert all(a < b <= c for (a, b, _), (c, _, _) in zip(got, got[1:]))


def test_segment_example():
    got = toxicity.maximal_segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5], float))
    assert got == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def held_out(spark, scored, target, divisor, rest):
    labels = spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", F.col(target).alias("truth"))
    rows = scored.where(remainder("doc_id", divisor) == rest).join(labels, "doc_id").select("score", "truth").collect()
    return np.array([r.score for r in rows]), np.array([r.truth for r in rows])


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    score, truth = held_out(spark, toxicity.toxic_rows(docs, labels), "toxic", 3, 1)
    assert (score[truth == 1] >= 0.7).mean() > 0.8
    assert (score[truth == 0] >= 0.7).mean() < 0.02
    assert ((score >= 0) & (score <= 1)).all()


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    score, truth = held_out(spark, quality.quality_rows(docs, labels), "quality", 5, 0)
    assert (score[truth == 1] >= 0.3).mean() > 0.98
    assert (score[truth == 0][:, None] < score[truth == 1][None]).mean() > 0.98


@pytest.mark.parametrize("rows", [quality.quality_rows, toxicity.toxic_rows])
def test_models_take_odd_rows(rows, frame, spark):
    """Null, empty and long texts are scored; without labels all scores agree; an empty table is empty."""
    schema = "doc_id long, quality int, toxic int"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 0), (3, None, None), (999, 1, 1)], schema)
    for labels in (none, some):
        got = rows(frame(odd_rows()), labels).collect()
        assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
        assert all(r.predicted in (0, 1) for r in got)
        blank = {round(r.score, 12) for r in got if r.doc_id in (1, 2, 3)}
        assert len(blank) == 1
    assert rows(frame([]), some).count() == 0


def test_same_model_at_every_run(frame, spark):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = [(i, ("bad thing here " if i % 2 else "nice day out ") * (1 + i % 5) + f"n{i}") for i in range(300)]
    for rows in (quality.quality_rows, toxicity.toxic_rows):
        runs = [sorted((r.doc_id, round(r.score, 9)) for r in rows(frame(docs).repartition(n), labels).collect()) for n in (1, 5)]
        assert runs[0] == runs[1]
        assert np.mean([s for i, s in runs[0] if i % 2]) != pytest.approx(np.mean([s for i, s in runs[0] if i % 2 == 0]))


def test_leader_learns_like_the_published_update():
    leader = quality.Leader(alpha=0.5, beta=1.0, l1=0.1, l2=1.0)
    z, n = {}, {}
    for at, value, label in (([3, 5], [1.0, 0.5], 1), ([5], [1.0], 0), ([3, 9], [0.2, 2.0], 1)) * 4:
        leader.learn(np.array(at), np.array(value), label)
        w = {}
        for i in at:
            zi, ni = z.get(i, 0.0), n.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= 0.1 else -(zi - np.sign(zi) * 0.1) / ((1 + ni**0.5) / 0.5 + 1)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, value))))
        for i, v in zip(at, value):
            g = (p - label) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.5
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
    assert [leader.z[i] for i in (3, 5, 9)] == pytest.approx([z[i] for i in (3, 5, 9)])


def slow_hits(index, words, threshold):
    """Every passage against every entry, by the sum of the shares of common terms."""
    terms = [index.vocabulary.get(w, -1) for w in words]
    shares = {}
    for t, blocks in enumerate(index.lists):
        for posting in blocks.values():
            for e, s in posting:
                shares[(t, e)] = s
    found = set()
    for p in range(max(0, -(-(len(terms) - 128) // 64)) + 1):
        inside = set(terms[64 * p : 64 * p + 128]) - {-1}
        for e in range(len(index.items)):
            if sum(shares.get((t, e), 0.0) for t in inside) >= threshold:
                found.add((p, e))
    return found


@pytest.mark.parametrize("threshold", [0.15, 0.3, 0.5])
def test_wand_finds_all_above_the_threshold(threshold, spark, corpus, sf):
    items = decontaminate.items_of(spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    index = decontaminate.build_index([tuple(r) for r in items], threshold)
    for r in corpus.limit(60).collect():
        words = decontaminate.words_of(r.text)[:3000]
        terms = np.array([index.vocabulary.get(w, -1) for w in words], np.int32)
        got = set()
        for passage, block in decontaminate.promising(index, terms, threshold):
            inside = list(set(terms[passage * 64 : passage * 64 + 128].tolist()) - {-1})
            got |= {(passage, e) for e, _ in decontaminate.wand(index, inside, block, threshold)}
        assert got == slow_hits(index, words, threshold)


def test_leaks_match_containment(spark, corpus, sf):
    """Every item that stands in a document word for word is found, and nothing that shares little with it."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " ".join(decontaminate.words_of(t or ""))
    docs = {r.doc_id: norm(r.text) for r in corpus.collect()}
    want = {(d, i.item_id) for d, t in docs.items() for i in bench.collect() if norm(i.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(corpus, decontaminate.items_of(bench)).collect()}
    assert want and want <= got
    assert len(got - want) <= 0.1 * len(want)


def test_leaks_of_odd_rows(frame, spark):
    question, answer = "what is the name of the river that runs through the old town", "it is the long grey river"
    items = spark.createDataFrame(
        [(1, question, answer), (2, None, None), (3, "too short", ""), (None, question, answer), (4, " ".join(f"t{i}" for i in range(500)), None)],
        "item_id long, question string, answer string",
    )
    docs = [*odd_rows(), (20, f"so {question} then {answer} end"), (21, question + " and nothing else"), (22, "t1 " * 300)]
    docs += [(23, " ".join(f"t{i}" for i in range(500)).upper()), (24, "the visit was Too short, they said"), (25, "too long or short")]
    got = decontaminate.leaks(frame(docs), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(20, 1), (23, 4), (24, 3)}
    assert decontaminate.leaks(frame(docs), items.limit(0)).count() == 0
    assert decontaminate.leaks(frame([]), items).count() == 0


def test_index_in_shards_finds_the_same(frame, spark, corpus, sf, monkeypatch):
    bench = decontaminate.items_of(spark.read.parquet(f"{sf}/benchmark.parquet"))
    pairs = lambda: {(r.doc_id, r.item_id, round(r.score, 12)) for r in decontaminate.leaks(corpus, bench).collect()}
    whole = pairs()
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2_000)
    assert pairs() == whole


def test_training_sample_is_bounded_when_ids_repeat(spark, frame):
    docs = keyed(frame([(i % 5, f"text {i}") for i in range(200)] + [(7, "same")] * 50), "doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    sample = training_sample(docs, labels, "quality", F.lit(True), 100)
    rows = docs.join(sample, KEY).select("doc_id", "label").collect()
    assert sorted(map(tuple, rows)) == [(0, 0), (1, 1), (2, 0), (3, 1), (4, 0), (7, 1)]
