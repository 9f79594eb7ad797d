"""Source divergences against plain Python integers, and the trees against a sum over all leaves."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import DOCUMENTS

from lanewise.llm.divergence import divergence, forest, priced_pairs, shares

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def slow_divergence(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(lowered(text or ""))
        groups[lang].add(source)
        count[lang, source].update(terms)
        count[lang, None].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def share(group):
            c = count[lang, group]
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p = {s: share(s) for s in [*sources, None]}
        gap = lambda x, y: (x - y) * (x - y) // (x + y)
        for s in sources:
            pairs = [(sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(gap(p[s][t], p[None][t]), t) for t in kept if count[lang, s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda i: (-i[0], i[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(ranked) if part == "pair" or k < top]
    return out


def made_rows():
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "abcdefghijk" for b in ("x", "Y", "é", "漢", "zz")]
    rows = [(None, None, None), ("", "en", "empty"), ("123 456 !", "en", "marks"), ("one two", "xx", "alone"), ("rare words", "yy", "p"), (None, "yy", "q")]
    for lang in ("en", "de", None):
        for source in ("s1", "s2", "ß", "漢", None):
            favourites = rng.choice(words, 30)
            for _ in range(int(rng.integers(3, 14))):
                rows.append((" ".join(rng.choice(favourites, rng.integers(0, 60))) + "-" + str(rng.choice(words)), lang, source))
    rows += [(rows[-1])] * 25  # a group of copies
    rows.append(("long " * 30_000, "en", "s1"))
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOCUMENTS).selectExpr("*", "'clash' AS term", "1 AS n", "2 AS total", "3 AS number", "4 AS rank", "5 AS value")


@pytest.mark.parametrize("kind", ["made", "corpus", "empty"])
def test_matches_plain_integers(kind, spark, corpus):
    rows = [(r.text, r.lang, r.source) for r in corpus.collect()] if kind == "corpus" else made_rows() if kind == "made" else []
    got = [tuple(r) for r in divergence(corpus if kind == "corpus" else frame_of(spark, rows)).collect()]
    assert sorted(got) == sorted(slow_divergence(rows))


def test_block_width_does_not_change_the_result(spark, monkeypatch):
    from lanewise.llm import divergence as module

    rows = made_rows()
    monkeypatch.setattr(module, "BLOCK", 64)
    assert sorted(tuple(r) for r in divergence(frame_of(spark, rows)).collect()) == sorted(slow_divergence(rows))


def test_equal_subtrees_are_one_node():
    leaves = np.array([[0, 0, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 0, 0, 0, 0], [0, 0, 0, 0, 1, 2, 0, 0]])
    counts, levels, roots = forest(leaves)
    assert counts.tolist() == [0, 1, 2] and [len(left) for left, _ in levels] == [2, 2, 2]
    assert roots[0] == roots[2] != roots[1]


def test_pair_prices_are_sums_over_leaves():
    rng = np.random.default_rng(2)
    leaves = rng.integers(0, 3, (7, 64)) * rng.integers(0, 2, (7, 64))
    leaves[:, 50:] = -1
    totals = np.where(leaves > 0, leaves, 0).sum(1) + 5
    a, b = np.triu_indices(7, 1)
    for i, j, got in zip(a, b, priced_pairs(leaves, totals, 60, a, b)):
        share = lambda r: [1 + 10**9 * (int(c) + 2) // (int(totals[r]) + 120) for c in leaves[r, :50]]
        assert got == sum((p - q) ** 2 // (p + q) for p, q in zip(share(i), share(j)))


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 5, 10**12, 4 * 10**15])
    totals = np.array([0, 10**9, 7, 3 * 10**12, 4 * 10**15])
    want = [1 + 10**9 * (int(c) + 2) // (int(n) + 2 * 1000) for c, n in zip(counts, totals)]
    assert shares(counts, totals, 1000).tolist() == want
