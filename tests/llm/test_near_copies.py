"""The pipeline's near-duplicate stage against all pairs of five-word shingle sets."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest
from conftest import odd_rows
from pyspark.sql import functions as F

from lanewise.llm import near_copies, simhash
from lanewise.llm.near_copies import _parity_bits
from lanewise.llm.simhash import fingerprint


def slow_sets(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_kept(rows):
    """doc_ids and texts that stay: of each group linked by similarity 0.8 the least row."""
    sets = [slow_sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    groups = defaultdict(list)
    for k, row in enumerate(rows):
        groups[find(k)].append(row)
    return Counter(min(own, key=lambda r: (r[0] is None, r[0] or 0))[0] for own in groups.values())


def made_rows():
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(60)]
    rows, doc = [(None, None), (900, ""), (901, " \n")], 0
    for group in range(6):
        base = [f"g{group}w{i}" for i in range(rng.integers(8, 120))]
        for _ in range(12):  # 0 to 5 words changed: similarities on both sides of 0.8
            words = list(base)
            for k in range(rng.integers(0, 6)):
                words[rng.integers(len(words))] = f"x{doc}y{k}"
            rows.append((doc, " ".join(words)))
            doc += 1
    for size in (0, 5, 10, 14, 15, 16, 17, 40):  # one common passage with own words behind it
        rows.append((doc, " ".join(passage + [f"o{doc}z{i}" for i in range(size)])))
        doc += 1
    return rows


@pytest.mark.parametrize("kind", ["made", "odd", "corpus", "empty"])
def test_stage_takes_every_near_copy(kind, spark, frame, corpus, sf):
    df = corpus if kind == "corpus" else frame({"made": made_rows(), "odd": odd_rows(), "empty": []}[kind])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = Counter(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, sf).collect())
    assert got == slow_kept(rows)


def test_ordinary_near_copies_are_further_than_four_bits_and_go(spark, frame, sf):
    words = [f"word{i}" for i in range(100)]
    copy = words[:30] + ["other"] + words[31:70] + ["another"] + words[71:]
    texts = [" ".join(words), " ".join(copy)]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() > 4
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame([(1, texts[0]), (2, texts[1])]), sf).collect()] == [1]


def test_parity_bits_never_differ_more_than_the_sets():
    rng = np.random.default_rng(5)
    for size in (0, 1, 30, 700, 9000):
        x = np.unique(rng.integers(-(2**63), 2**63 - 1, size))
        for other in (0, 3, size // 5):
            y = np.unique(np.concatenate([x[other:], rng.integers(-(2**63), 2**63 - 1, other)]))
            differ = sum(int(a ^ b).bit_count() for a, b in zip(_parity_bits(x).view(np.uint64).tolist(), _parity_bits(y).view(np.uint64).tolist()))
            assert differ <= len(np.setxor1d(x, y))


def test_stage_takes_the_links_of_simhash_first(spark, frame, monkeypatch):
    """A long text and its copy are linked by their fingerprints, a short pair of one component is checked and stays."""
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(words), " ".join(words[:1500] + ["other"] + words[1501:]), "something else"]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() <= 4
    seen, plain = [], near_copies.simhash_pairs
    monkeypatch.setattr(near_copies, "simhash_pairs", lambda *args: seen.append(plain(*args)) or seen[-1])
    rows = near_copies.near_copies(frame(list(enumerate(texts)))).collect()
    assert sorted(r["first"] for r in rows) == [False, True, True]
    assert seen[0].count() == 1


def test_a_common_passage_makes_no_pairs_of_unlike_texts(spark, frame, monkeypatch):
    """Texts of one passage and as many own words leave the join in no rows, however many there are."""
    rng = np.random.default_rng(4)
    passage = [f"p{i}" for i in range(60)]
    rows = [(doc, " ".join(passage + [f"o{doc}z{i}" for i in rng.permutation(60)])) for doc in range(80)]
    monkeypatch.setattr(near_copies, "SAMPLE", 1)  # so that the passage's shingles are not known to be common
    made, plain = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *args: made.append(pairs.count()) or plain(pairs, *args))
    assert near_copies.near_copies(frame(rows)).where("first").count() == 80
    assert made[-1] == 0


def test_a_group_of_near_copies_folds_without_all_its_pairs(spark, frame, monkeypatch):
    """Copies of one text, each with its own changes, nearer to each other than to be told apart by one hub."""
    rng = np.random.default_rng(6)
    rows = []
    for doc in range(150):
        words = [f"base{i}" for i in range(200)]
        for k in rng.choice(200, 3 if doc else 9, replace=False):
            words[k] = f"x{doc}y{k}"
        rows.append((doc, " ".join(words)))
    made, plain = [], near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda pairs, *args: made.append(pairs.count()) or plain(pairs, *args))
    got = near_copies.near_copies(frame(rows))
    want = slow_kept(rows)
    assert got.where("first").count() == sum(want.values()) < 150
    assert max(made) <= 150 * 40  # rows of the prefixes: no more than 40 of each set


def _written(monkeypatch, module, seen):
    plain = module.write_table
    monkeypatch.setattr(module, "write_table", lambda df, name, *more: seen.append((name, plain(df, name, *more))) or seen[-1][1])


def test_a_shingle_that_no_set_has_early_links_nothing(spark):
    """Of two near sets the smaller has the first shingle they share within its first ninth."""
    places = spark.createDataFrame([(1, 90, 11), (1, 95, 12), (2, 90, 10), (2, 95, 12), (3, 90, 0)], "shingle long, n int, at int")
    assert [r.shingle for r in near_copies._meetings(places, (4, 5)).collect()] == [2]


def test_hubs_are_not_drawn_again_for_few_links(spark, frame, monkeypatch):
    """A draw that links less than a tenth of what is linked already is the last; the join finds the rest."""
    rng = np.random.default_rng(8)
    rows = []
    for doc in range(150):
        words = [f"base{i}" for i in range(200)]
        for k in rng.choice(200, 3 if doc else 9, replace=False):
            words[k] = f"x{doc}y{k}"
        rows.append((doc, " ".join(words)))
    for doc in range(150, 450):
        rows.append((doc, " ".join(f"pair{doc // 2}w{i}" for i in range(40 + doc % 2))))
    seen = []
    _written(monkeypatch, near_copies, seen)
    monkeypatch.setattr(near_copies, "_more_pairs_than_rows", lambda active: True)
    got = near_copies.near_copies(frame(rows))
    assert got.where("first").count() == sum(slow_kept(rows).values())
    assert [name for name, _ in seen].count("hubs") <= 2  # the first, and one draw


def test_keys_of_few_prints_are_not_broadcast(spark, monkeypatch):
    """A small table of prints has many keys each: the join of keys and hubs moves both by key."""
    seen, plain = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda edges: seen.append(edges) or plain(edges))
    prints = spark.createDataFrame([(i * i * 7919,) for i in range(300)], "print long")
    assert simhash.print_components(prints).count() == 300
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_texts_pass_to_tasks_in_small_batches_and_the_setting_comes_back(spark, frame, monkeypatch):
    key, seen, plain = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, near_copies.write_table
    monkeypatch.setattr(near_copies, "write_table", lambda df, name, *more: seen.update({name: int(spark.conf.get(key))}) or plain(df, name, *more))
    before = spark.conf.get(key)
    docs = frame([(i, f"one two three four five {i % 3}") for i in range(9)])
    assert near_copies.near_copies(docs).where("first").count() == 3
    assert spark.conf.get(key) == before and int(before) > 1_000
    assert {seen[name] for name in ("shingles", "texts", "near")} == {1_000}


def test_a_link_that_the_least_set_of_a_simhash_component_does_not_show_is_found(spark, frame, monkeypatch):
    """One SimHash component of everything, and none at all: what is near, however far from the least set, goes all the same."""
    rows = made_rows()
    want = sum(slow_kept(rows).values())
    for root in (F.lit(0).cast("long"), F.col("print")):
        monkeypatch.setattr(near_copies, "print_components", lambda of, root=root: of.select("print").distinct().select("print", root.alias("root")))
        assert near_copies.near_copies(frame(rows)).where("first").count() == want < len(rows) - 20
