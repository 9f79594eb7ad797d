"""Substring dedup against brute force: every repeated span of whole sentences goes, to its last one."""

import re
from collections import defaultdict

import numpy as np
from test_dedup import slow_sentences

from lanewise.llm.substring_dedup import covering_runs, deduplicated


def spans(a, b):
    """Maximal equal spans (place in a, length) of two lists of sentences, by trying all places."""
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                yield i, n


def slow_spans(rows):
    """Sentences of each later text in spans shared with an earlier one that hold a run; no text repeats itself."""
    parts, drops = [[" ".join(s.lower().split()) for s in slow_sentences(t)] for _, t in rows], defaultdict(set)
    for later in range(len(rows)):
        for earlier in range(later):
            for i, n in spans(parts[later], parts[earlier]):
                counts = [len(s.split()) for s in parts[later][i : i + n]]
                if (n >= 2 and sum(counts) >= 25) or max(counts) >= 50:
                    drops[rows[later][0]] |= set(range(i, i + n))
    return drops


def sentence(name, words):
    return " ".join(f"{name}{k}" for k in range(words)) + "."


def made_rows():
    rng = np.random.default_rng(7)
    pool = [sentence(f"s{i}q", int(rng.choice([1, 3, 8, 11, 15, 23, 33, 60]))) for i in range(40)]
    rows = [(0, " ".join(sentence(f"a{k}q", n) for k, n in enumerate([23, 11, 33, 8, 15])))]
    rows.append((1, sentence("own", 9) + " " + rows[0][1] + " " + sentence("end", 30)))
    for doc in range(2, 30):
        at, n = int(rng.integers(0, 30)), int(rng.integers(1, 10))
        rows.append((doc, " ".join([sentence(f"b{doc}q", 5), *pool[at : at + n], sentence(f"e{doc}q", 7)])))
    return rows


def test_spans_go_to_their_last_sentence(frame):
    rows = made_rows()
    got = {r.doc_id: {i for p in r.passages for i in range(p.first_sentence, p.last_sentence + 1)} for r in deduplicated(frame(rows)).collect()}
    assert got[1] == {1, 2, 3, 4, 5}
    assert got == {doc: own for doc, own in slow_spans(rows).items() if own}


def test_a_whole_copy_leaves_nothing(frame):
    text = " ".join(sentence(f"c{k}q", n) for k, n in enumerate([20, 20, 4]))
    assert [(r.doc_id, r.text.strip()) for r in deduplicated(frame([(1, text), (2, text)])).collect()] == [(2, "")]


def test_each_place_and_length_once():
    text = " ".join(sentence(f"d{k}q", n) for k, n in enumerate([20, 20, 60, 4])).encode()
    found = [r[:2] for r in covering_runs(text, re.compile(rb"(?<=[.!?])[ ]+"), 2, 25, 50)]
    assert found == sorted(set(found)) == [(0, 2), (1, 2), (2, 1), (2, 2)]
