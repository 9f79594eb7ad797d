"""Each stage on what its predecessor kept, against plain Python, and the queries against SQL."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connection, difference
from conftest import odd_rows
from pyspark.sql import functions as F
from test_near_copies import slow_kept

import corpus_pipeline
from lanewise.llm import decontaminate, mixing, rows, toxicity
from lanewise.llm.mixing import mix
from lanewise.llm.oracle import ORACLE
from lanewise.llm.queries import QUERIES
from lanewise.llm.sharding import permute
from lanewise.session import write_table


def keys(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def expect_stages(spark, docs, sf):
    """Runs the stages one after the other and checks what each did to its input."""
    columns = docs.columns
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    before, kept = keys(docs), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        last = name == "sharding"
        assert out.columns == (columns + ["shard", "slot"] if last else columns)
        docs = write_table(out, name)
        kept[name] = keys(docs)
    score = {(r.doc_id, r.text) for r in _scored(spark, before, model)}
    want = Counter({k: n for k, n in before.items() if k not in score})
    assert kept["toxicity"] == want

    assert Counter(k[0] for k in kept["simhash"].elements()) == slow_kept(sorted(want.elements(), key=str))

    norm = lambda t: " ".join(decontaminate.words_of(t or ""))
    items = [norm(r.text) for r in bench.collect()]
    dropped = kept["simhash"] - kept["decontamination"]
    assert not kept["decontamination"] - kept["simhash"]
    assert {k for k in kept["simhash"] if any(i and i in norm(k[1]) for i in items)} <= set(dropped)
    return kept, docs


def _scored(spark, rows, model):
    df = spark.createDataFrame(list(rows), "doc_id long, text string")
    hits = toxicity.scores(df, model).where("score >= 0.7").select("doc_id").collect()
    ids = {r.doc_id for r in hits}
    return [r for r in df.collect() if r.doc_id in ids]


def test_stages_on_the_corpus(spark, corpus, sf):
    kept, final = expect_stages(spark, corpus, sf)
    assert {k for k in kept["mixing"]} <= set(kept["decontamination"])
    assert max(kept["mixing"].values()) <= 3
    rows, total = final.collect(), sum(kept["mixing"].values())
    assert keys(final) == kept["mixing"]
    assert sorted(r.slot * 16 + r.shard for r in rows) == list(range(total))
    ranked = sorted(rows, key=lambda r: (r.doc_id, r.text))
    places = permute(np.arange(total), total).tolist()
    by_doc = defaultdict(set)
    for r, place in zip(ranked, places):
        by_doc[r.doc_id].add(place)
    assert all(r.slot * 16 + r.shard in by_doc[r.doc_id] for r in rows)


def test_mixing_stage_repeats_what_the_operator_takes(spark, corpus, sf):
    out = keys(corpus_pipeline.mix_sources(spark, corpus, sf))
    assert {k[0]: n for k, n in out.items()} == {r.doc_id: r.copies for r in mix(corpus).collect() if r.copies}


def test_mixing_stage_joins_texts_to_marks_of_64_rows(spark, corpus, sf, monkeypatch):
    """What the texts meet has a row for 64 documents of a file, not one for each."""
    seen = []
    for module in (mixing, rows):
        monkeypatch.setattr(module, "write_table", lambda df, name, plain=module.write_table: seen.append((name, plain(df, name))) or seen[-1][1])
    docs = write_table(corpus.coalesce(1), "corpus")
    out = corpus_pipeline.mix_sources(spark, docs, sf)
    name, marks = seen[-1]
    assert marks.count() <= docs.count() / 64 + 1
    assert keys(out) == keys(corpus_pipeline.mix_sources(spark, docs, sf))


def test_stages_take_odd_rows(spark, frame, sf):
    for rows in (odd_rows(), []):
        docs = frame(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = write_table(stage(spark, docs, sf), "odd")
        final = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert final.count() == docs.count()


def test_run_agrees_with_its_stages(spark, sf, corpus):
    _, final = expect_stages(spark, corpus, sf)
    pick = lambda df: Counter((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert pick(corpus_pipeline.run(spark, sf)) == pick(final)


CLASHING = (
    "lanewise_file lanewise_row lanewise_block lanewise_bits lanewise_drop lanewise_other lanewise_row_as_given _metadata "
    "mix_copies mix_copy mix_lanewise_row shard_place shard_lanewise_row a.b tick`ed"
).split()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_keep_columns_of_any_name(spark, frame, sf, stage):
    named = frame(odd_rows()).withColumns({c.replace("`", "``"): F.lit(c) for c in CLASHING if "." not in c and "`" not in c})
    named = named.select("*", *[F.lit(c).alias(c) for c in CLASHING if "." in c or "`" in c])
    plain_rows = Counter(stage(spark, frame(odd_rows()), sf).select("doc_id", "text").collect())
    out = stage(spark, write_table(named, "named"), sf)
    assert out.columns[: len(named.columns)] == named.columns
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(tuple(r) for r in plain_rows.elements())
    assert all(r[c] == c for r in rows for c in CLASHING)


def test_rows_without_ids_spread_over_hash_ranges(spark, frame):
    rows = [(None, f"word number {i} of the text", "s") for i in range(400)] + [(i, "x y z", "t") for i in range(900)]
    out = mix(frame(rows)).where("source = 's'").collect()
    assert {r.copies for r in out} <= {0, 1, 2, 3}
    assert abs(sum(r.taken for r in out) - out[0].target) < 6


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf):
    assert difference(QUERIES[name](spark, sf), connection(sf), ORACLE[name]) is None
