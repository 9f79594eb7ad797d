"""SimHash, exact, substring and line dedup against plain Python over the same rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest import odd_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lanewise.llm import components as llm_components
from lanewise.llm.components import components
from lanewise.llm.exact_dedup import exact_duplicates, golomb_decode, golomb_encode
from lanewise.llm.line_dedup import line_duplicates, patience
from lanewise.llm.simhash import block_masks, near_duplicates, print_components
from lanewise.llm.substring_dedup import deduplicated, repeated_passages, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_components(prints, distance=4):
    """Least element of each linked group, by trying all pairs."""
    prints = sorted(set(prints))
    up = {p: p for p in prints}

    def find(p):
        while up[p] != p:
            p = up[p]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {p: find(p) for p in prints}


def expected_near(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(prints)
    least = {}
    for (doc, _), p in zip(rows, prints):
        if doc is not None:
            least[roots[p]] = min(doc, least.get(roots[p], doc))
    return sorted(((d, f"{p:016x}", least.get(roots[p])) for (d, _), p in zip(rows, prints)), key=str)


@pytest.mark.parametrize("kind", ["odd", "corpus", "empty"])
def test_near_duplicates(kind, frame, corpus):
    df = corpus if kind == "corpus" else frame(odd_rows() if kind == "odd" else [])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == expected_near(rows)
    heads = defaultdict(int)
    for r in got:
        heads[r.component_id] += r["first"]
    assert set(heads.values()) <= {1}


def test_linked_prints_in_a_ball_and_a_chain(spark):
    """A hub with many near prints, a chain of single steps, and strangers: no link is lost."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(1 << 62))
    ball = [centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(150)]
    chain = [centre ^ ((1 << 40) - 1)]
    for k in range(12):
        chain.append(chain[-1] ^ (0b1111 << (4 * k)))
    rest = [int(x) for x in rng.integers(0, 1 << 63, 100)]
    prints = [p - (1 << 64) if p >> 63 else p for p in {*ball, *chain, *rest, centre}]
    df = spark.createDataFrame([(p,) for p in prints] + [(prints[0],)] * 5, "print long")
    got = {r.print: r.root for r in print_components(df).collect()}
    want = slow_components([p % (1 << 64) for p in prints])
    groups = lambda m: sorted(sorted(v) for v in _invert(m).values())
    assert groups({k % (1 << 64): v for k, v in got.items()}) == groups(want)


def _invert(mapping):
    out = defaultdict(list)
    for k, v in mapping.items():
        out[v].append(k)
    return out


@pytest.mark.parametrize("count", [1, 100, 10**6, 10**8])
def test_blocks_catch_every_close_pair(count):
    masks = [m % (1 << 64) for m in block_masks(count, 4)]
    rng = np.random.default_rng(count)
    for _ in range(300):
        flip = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flip & m == 0 for m in masks)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7)] + [(1000, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 1000: 0, **{100 + i: 100 for i in range(1, 200)}}
    assert components(df.limit(0)).count() == 0


def test_few_edges_are_finished_by_one_task_as_by_the_steps(spark, monkeypatch):
    rng = np.random.default_rng(11)
    ends = rng.integers(-(2**62), 2**62, 400)[rng.integers(0, 400, (300, 2))].tolist()
    ends += [(i, i + 1) for i in range(60, 0, -1)] + [(7, 7)] + [(-5, i) if i % 2 else (i, -5) for i in range(900, 960)]
    df = spark.createDataFrame(ends, "a long, b long").repartition(5)
    seen, plain = [], llm_components.write_table
    monkeypatch.setattr(llm_components, "write_table", lambda out, name, *more: seen.append(name) or plain(out, name, *more))
    got = {r.node: r.root for r in components(df).collect()}
    assert seen == ["edges", "roots"]
    monkeypatch.setattr(llm_components, "FINISH_EDGES", 0)
    assert got == {r.node: r.root for r in components(df).collect()}
    assert seen.count("edges") > 3


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**48 - 1), max_size=300))
def test_golomb_round_trip(values):
    values = np.array(sorted(values), np.uint64)
    assert golomb_decode(golomb_encode(values)).tolist() == values.tolist()


def test_golomb_is_smaller_than_the_hashes():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 16_384).astype(np.uint64))
    assert len(golomb_encode(values)) * 8 / len(values) < 38


def expected_exact(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc, text or ""))
    out = []
    for bare, own in groups.items():
        keep = min(own, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        digest = hashlib.sha256(bare.encode()).hexdigest()
        out += [(d, keep[0], len(own), digest) for d, _ in own]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["odd", "corpus", "empty"])
def test_exact_duplicates(kind, frame, corpus):
    df = corpus if kind == "corpus" else frame(odd_rows() if kind == "odd" else [])
    got = exact_duplicates(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected_exact([(r.doc_id, r.text) for r in df.collect()])
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) <= {1}


def test_exact_over_many_partitions_and_owners(frame, monkeypatch):
    from lanewise.llm import exact_dedup

    monkeypatch.setattr(exact_dedup, "OWNER_PRINTS", 7)
    rows = [(i, f"text {i % 20}" + " " * (i % 3)) for i in range(200)]
    got = exact_duplicates(frame(rows).repartition(5)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected_exact(rows)


SENTENCE = re.compile(r"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+")


def slow_sentences(text):
    return [s for s in SENTENCE.split(text or "") if WORD.search(s)]


def slow_parts(text):
    return [" ".join(WORD.findall(s.lower() if s.isascii() else "".join(c.lower() if "A" <= c <= "Z" else c for c in s))) for s in slow_sentences(text)]


def slow_covering(text):
    """Runs that begin and runs that end at each sentence."""
    parts = slow_parts(text)
    ended = [(len(parts) - i - n, n, key[::-1]) for i, n, key in slow_runs_of(parts[::-1])]
    return sorted({*slow_runs_of(parts), *ended})


def slow_runs(text):
    return slow_runs_of(slow_parts(text))


def slow_runs_of(parts, sentences=2, words=25, long=50):
    out = []
    for i in range(len(parts)):
        if len(parts[i].split(" ")) >= long:
            out.append((i, 1, tuple(parts[i : i + 1])))
            continue
        for j in range(i + sentences, len(parts) + 1):
            if sum(len(p.split(" ")) for p in parts[i:j]) >= words:
                out.append((i, j - i, tuple(parts[i:j])))
                break
    return out


def slow_dropped(rows):
    first, drops = {}, defaultdict(set)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        for i, n, key in slow_covering(rows[k][1]):
            if first.setdefault(key, (k, i)) != (k, i):
                drops[k] |= set(range(i, i + n))
    return drops


def test_runs_agree_with_the_plain_ones(corpus):
    between = re.compile(rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+")
    texts = [r.text for r in corpus.collect()] + [" ".join(["w"] * 60) + ". Short one. " + " ".join(["v"] * 30) + ".", "x. " * 40]
    for text in texts:
        assert [r[:2] for r in runs(text.encode(), between, 2, 25, 50)] == [r[:2] for r in slow_runs(text)]


@pytest.mark.parametrize("kind", ["made", "corpus", "empty"])
def test_substring_dedup(kind, frame, corpus):
    passage = "The quick brown fox runs over the lazy dog again today. Then it rests for many long hours under the old green tree near water. At last it goes home to eat and sleep well."
    made = [
        (3, "Own start here. " + passage + " Own end of three."),
        (1, passage),
        (2, "Nothing shared in this short text at all."),
        (None, "Before.\n" + passage.upper() + "\nAfter."),
        (5, passage + " " + passage),
        (5, passage + " " + passage),
        (6, None),
        (7, ""),
    ]
    df = corpus if kind == "corpus" else frame(made if kind == "made" else [])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = slow_dropped(rows)
    got = deduplicated(df).collect()
    kept = lambda t, d: [s for i, s in enumerate(slow_sentences(t)) if i not in d]
    expected = sorted((rows[k][0], len(d), kept(rows[k][1], d)) for k, d in want.items() if rows[k][0] is not None)
    assert sorted((r.doc_id, r.removed_sentences, slow_sentences(r.text)) for r in got if r.doc_id is not None) == expected
    assert len(got) == len(want)
    if kind == "made":
        assert {(r.doc_id, tuple(r.first_doc_ids)) for r in repeated_passages(df).collect()} == {(3, (1,)), (None, (1,)), (5, (1,)), (5, (1, 5))}


def test_patience_keeps_order_and_finds_moved_blocks():
    a, b = [1, 2, 3, 4, 5, 6], [9, 2, 3, 8, 5, 6]
    assert patience(a, b) == [(1, 1), (2, 2), (4, 4), (5, 5)]
    for x, y in (([], [1]), ([1, 1, 2], [1, 2, 1]), (list(range(50)), list(range(25, 50)) + list(range(25)))):
        pairs = patience(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert len(patience(list(range(50)), list(range(25, 50)) + list(range(25)))) == 25


def slow_blocks(later, earlier, smallest=8):
    lines = lambda t: [" ".join(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x)]
    a, b = lines(later), lines(earlier)
    pairs, drop = patience(a, b), set()
    for n, (i, j) in enumerate(pairs):
        lo = hi = n
        while lo and pairs[lo - 1] == (pairs[lo][0] - 1, pairs[lo][1] - 1):
            lo -= 1
        while hi + 1 < len(pairs) and pairs[hi + 1] == (pairs[hi][0] + 1, pairs[hi][1] + 1):
            hi += 1
        if sum(len(a[k].split(" ")) for k, _ in pairs[lo : hi + 1]) >= smallest:
            drop.add(i)
    return drop


def slow_lines(rows):
    """Deletions of each row, pairing texts by their shared lines as documented."""
    lines = lambda t: [" ".join(WORD.findall(x)) for x in (t or "").split("\n") if WORD.search(x)]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    head, holders = {}, defaultdict(list)
    for k in order:
        if head.setdefault(rows[k][1], k) == k:
            for x in set(lines(rows[k][1])):
                if len(x.split(" ")) >= 3:
                    holders[x].append(k)
    rank = {k: n for n, k in enumerate(order)}
    pairs = set()
    for own in holders.values():
        pairs |= {(k, own[0]) for k in own[1:]}
        if len(own) <= 4:
            pairs |= {(b, a) for a in own for b in own if rank[a] < rank[b]}
    drops, links = defaultdict(set), defaultdict(set)
    for later, earlier in pairs:
        if found := slow_blocks(rows[later][1], rows[earlier][1]):
            drops[later] |= found
            links[later].add(earlier)
            links[earlier].add(later)
    out = []
    for k, (doc, text) in enumerate(rows):
        h = head[text]
        n = len(lines(text))
        out.append((doc, rows[h][0], len(links[h]), n, n if k != h else len(drops[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["made", "corpus", "empty"])
def test_line_dedup(kind, frame, corpus):
    block = "a line with a few words of its own\nand one more line that follows it here\nthen a third"
    made = [(i, f"top line number {i} of this text\n{block}\nlast line number {i % 3} here") for i in range(9)]
    made += [(20, block), (20, block), (21, None), (22, ""), (None, "top line number 3 of this text\n\n" + block), (23, "no line shared")]
    df = corpus if kind == "corpus" else frame(made if kind == "made" else [])
    rows = [(r.doc_id, r.text) for r in df.collect()]
    if kind == "made":
        rows = [(d, t) for d, t in rows]
    found, changed = line_duplicates(df)
    got = sorted(((r.doc_id, r.class_id, r.links, r.lines, r.deleted_lines) for r in found.collect()), key=str)
    assert got == slow_lines([(d, t or "") for d, t in rows])
    assert changed.count() == sum(r[4] > 0 for r in got)
