"""Common blocks of op4 whose single lines do not lead to a text that holds the block."""

from collections import defaultdict

from test_dedup import slow_blocks

from lanewise.llm.line_dedup import block_keys, line_duplicates


def every_pair(rows):
    """Deleted lines of each text by aligning it with every earlier one."""
    drops = defaultdict(set)
    for k, (doc, text) in enumerate(rows):
        for _, earlier in rows[:k]:
            drops[doc] |= slow_blocks(text, earlier)
    return {doc: len(own) for doc, own in drops.items()}


def deleted(frame, rows):
    return {r.doc_id: r.deleted_lines for r in line_duplicates(frame(rows))[0].collect()}


def test_a_block_of_common_lines_meets_its_first_holder(frame):
    a, b, c = "one two three four", "five six seven eight", "nine ten eleven"
    rows = [(0, f"{a}\nzero alone"), (1, f"{b}\none alone"), (2, f"{c}\ntwo alone")]
    rows += [(k, f"start of {k}\n{a}\n{b}\n{c}\nend of {k}") for k in range(3, 12)]
    got = deleted(frame, rows)
    assert got[11] == 3
    assert got == {0: 0} | every_pair(rows)


def test_blocks_of_short_lines_go(frame):
    menu = "\n".join(["Home", "About us", "News", "Shop", "Help", "Contact", "Log in"])
    rows = [(k, f"own{k}\n{menu}\nlast{k}") for k in range(7)]
    found = line_duplicates(frame(rows))[0].collect()
    assert {r.doc_id: r.deleted_lines for r in found} == {0: 0} | {k: 7 for k in range(1, 7)}
    assert all(r.links > 0 for r in found)


def test_the_end_of_a_block_goes_too(frame):
    long, tail = "a b c d e f g h i", "x y"
    rows = [(0, long)] + [(k, f"start {k}\n{long}\n{tail}\nend {k}") for k in range(1, 9)]
    assert deleted(frame, rows) == {0: 0} | every_pair(rows)


def test_keys_depend_on_the_block_only():
    inner, words = [11, 12, 13, 14], [3, 3, 3, 2]
    want = set(block_keys(inner, words))
    assert len(want) == 2 and want <= set(block_keys([1, *inner, 2], [1, *words, 1]))
