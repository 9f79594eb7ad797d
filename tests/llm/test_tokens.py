"""Tokenizer operators against the libraries on whole texts and a plain walk over byte offsets."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from conftest import odd_rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm.alignment import BYTE_BPE, PIECES, aligned, alignment, byte_tokens, terminals
from lanewise.llm.chunks import chunks, head, pieces_of
from lanewise.llm.piece_codes import encoded
from lanewise.llm.queries import QUERIES

MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
BPE = Tokenizer.from_file(BYTE_BPE)
BPE.encode_special_tokens = True
NAMES = byte_tokens(BYTE_BPE)


def hard_texts():
    """Blanks of all kinds, marks, bytes that no piece has, special tokens as text, one word without end."""
    texts = ["<s> </s><unk> <|endoftext|>", "  two  spaces   three ", "line\nline\n\n  indent\r\n\ttab", "no break 　 wide   x", "a▁b", "▁", " ", "\n", " \n ", "\x00 \x1c a\x1c b"]
    texts += ["漢字とかな 交じり 文 🎉🎉👩‍👩‍👧 é ", "'s 't 're it's we'll  's", "x" * 3000, "🎉" * 400, "ab " * 2000, "<0x41> <0x0A>", "1234567 89,000 3.14", " trailing  ", "Ⅷ ² ½ ﬁ ßẞ İi"]
    rng = np.random.default_rng(5)
    letters = list("ab é漢🎉\n\t  ' .1 ")
    texts += ["".join(rng.choice(letters, rng.integers(1, 60))) for _ in range(300)]
    return [(1000 + i, t) for i, t in enumerate(texts)]


def rows_of(kind, frame, corpus):
    return corpus if kind == "corpus" else frame({"hard": hard_texts(), "odd": odd_rows(), "empty": []}[kind])


KINDS = ["hard", "odd", "corpus", "empty"]


@pytest.mark.parametrize("kind, table", [(k, 1 << 17) for k in KINDS] + [("hard", 0)])
def test_ids_and_texts_are_the_librarys(kind, table, frame, corpus):
    df = rows_of(kind, frame, corpus)
    got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in encoded(df, table_rows=table).collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        ids = MODEL.encode(r.text or "")
        want[r.doc_id, tuple(ids), MODEL.decode(ids)] += 1
    assert got == want


def test_query_has_the_digests(spark, sf, corpus):
    got = {r.doc_id: r[1:] for r in QUERIES["op13_sentencepiece"](spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in corpus.collect():
        ids = MODEL.encode(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids))), sha(MODEL.decode(ids)))


def slow_groups(text):
    """Groups of (A ids, B ids) by walking the ends of both, or none."""
    if not text:
        return []
    sides = []
    for ids, token in ((BPE.encode(" " + text, add_special_tokens=False).ids, NAMES.__getitem__), (MODEL.encode(text), lambda i: bytes([int(MODEL.id_to_piece(i)[3:5], 16)]) if MODEL.is_byte(i) else MODEL.id_to_piece(i).replace("▁", " ").encode())):
        ends, at = [], 0
        whole = b""
        for i in ids:
            whole += token(i)
            ends.append((len(whole), i))
        if whole != (" " + text).encode():
            return []
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    out, start = [], 0
    for stop in cuts:
        out.append(tuple([i for e, i in side if start < e <= stop] for side in sides))
        start = stop
    return out


def slow_alignment(rows):
    groups = [(d, slow_groups(t)) for d, t in rows]
    linked = [Counter((a, b) for x, y in own for a in x for b in y) for _, own in groups]
    count = Counter(p for own in linked for p in own)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    for (doc, own), pairs in zip(groups, linked):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        sha = hashlib.sha256(text.encode()).hexdigest() if own else ""
        best = sum(n for p, n in pairs.items() if count[p] == most[p[0]])
        yield doc, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), sum(pairs.values()), best, sum(n * count[p] for p, n in pairs.items()), sha


@pytest.mark.parametrize("kind, head_rows", [(k, 500) for k in KINDS] + [("hard", 0), ("hard", 1 << 18)])
def test_alignment_is_the_walk(kind, head_rows, frame, corpus):
    df = rows_of(kind, frame, corpus)
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 20_000 else r.text[:9000]) for r in df.select("doc_id", "text").collect()]
    if kind == "odd":
        df = frame(rows)
    fields = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in alignment(df, head_rows=head_rows).select(*fields).collect()) == Counter(slow_alignment(rows))


def test_operator_returns_the_groups(frame):
    row = aligned(frame([(1, "Hello   wörld 🎉")])).first()
    own = slow_groups("Hello   wörld 🎉")
    assert row.groups == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
    want = Counter(a * MODEL.get_piece_size() + b for x, y in own for a in x for b in y)
    assert dict(zip(row.pairs, row.times)) == want


def test_pointers_reach_the_end_of_each_group():
    rng = np.random.default_rng(1)
    for _ in range(200):
        size = int(rng.integers(1, 200))
        a, b = (np.unique(np.r_[rng.integers(1, size + 1, rng.integers(1, 60)), size]) for _ in range(2))
        both = np.intersect1d(a, b)
        want = np.concatenate([np.searchsorted(both, x) for x in (a, b)])
        assert np.array_equal(np.unique(terminals(a, b), return_inverse=True)[1], want)


def test_chunks_give_the_text_back():
    for _, text in hard_texts():
        assert " ".join(chunks(text)) == text


def test_a_model_with_pieces_over_spaces_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, **_):
            pass

        get_piece_size = staticmethod(lambda: 2)
        id_to_piece = staticmethod(lambda i: ["a", "a▁b"][i])

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="cut at spaces"):
        pieces_of(public_tokenizers.path("piece_bpe_32k.model"))


def test_head_is_bounded_and_takes_the_largest(spark):
    df = spark.range(1, 2001).select("id", F.floor(F.lit(100_000) / F.col("id")).alias("n"))
    for limit in (0, 1, 50, 700, 5000):
        got = [r.id for r in head(df, "n", limit).collect()]
        assert len(got) <= limit and sorted(got) == list(range(1, len(got) + 1)) and (limit < 2000 or len(got) == 2000)
