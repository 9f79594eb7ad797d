"""Tokens of two tokenizers aligned by the bytes they cover, and how often their ids meet in a corpus."""

from __future__ import annotations

import gc
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lanewise.llm import chunks as cutting
from lanewise.llm.chunks import MARK, Table, grouped, head, int_lists, piece_ids, pieces_of
from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.session import write_table

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TASK_ROWS = 200_000  # chunks that a task keeps aligned
HEAD_ROWS = 1 << 18  # id pairs whose counts are broadcast
PAIRED = 64  # a group of more pairs than this is folded to distinct ids first


def byte_letters() -> dict[str, int]:
    """Letter of each byte in a byte-level vocabulary: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def byte_tokens(file: str) -> list[bytes]:
    """Bytes of each id of the byte-level tokenizer; added tokens stand for their own text."""
    letters = byte_letters()
    spec = json.loads(open(file, encoding="utf-8").read())
    out = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in spec["model"]["vocab"].items()}
    return [out.get(i, b"") for i in range(max(out) + 1)]


def piece_tokens(model: sentencepiece.SentencePieceProcessor) -> list[bytes]:
    """Bytes of each piece: the mark is a space, a byte piece its byte."""
    ids = range(model.get_piece_size())
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in ((i, model.id_to_piece(i)) for i in ids)]


def terminals(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Of each token, those of A first, the number of the token that ends its group.

    Both tile the same bytes. A token points to the farthest-right token that it overlaps; what
    ends where the other side ends, too, is a terminal (on the B side) and points to itself.
    Doubling the pointers takes every token to its terminal in a logarithmic number of rounds.
    """
    n = len(a_ends)
    to_b = np.searchsorted(b_ends, a_ends)  # the B token over an A token's last byte ends there or further right
    to_a = np.searchsorted(a_ends, b_ends)
    last = a_ends[to_a] == b_ends
    to = np.concatenate([to_b + n, np.where(last, np.arange(len(b_ends)) + n, to_a)])
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def group_pairs(a: np.ndarray, b: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs a * span + b of one group and how many links hold each, by distinct ids."""
    (a, m), (b, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    return (a[:, None] * span + b[None, :]).ravel(), (m[:, None] * n[None, :]).ravel()


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all lists and how many each holds."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _written(ids: int, inner: str, last: str) -> np.ndarray:
    """Each id as text, followed by one mark or the other: number 2 * id, and 2 * id + 1 for the last of its side."""
    return np.array([f"{i}{mark}" for i in range(ids) for mark in (inner, last)], object)


class Aligner:
    """Both tokenizers in one task."""

    def __init__(self, byte_bpe: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each further thread keeps memory of its own
        self.byte_bpe = Tokenizer.from_file(byte_bpe)
        self.byte_bpe.encode_special_tokens = True
        self.pieces = pieces_of(pieces)
        self.a_bytes, self.b_bytes = byte_tokens(byte_bpe), piece_tokens(self.pieces)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_text, self.b_text = _written(len(self.a_bytes), ",", "|"), _written(len(self.b_bytes), ",", ";")
        self.span = len(self.b_bytes)

    def _spelled(self, a: list[list[int]], b: list[list[int]], cut: list[str]) -> np.ndarray:
        """Which chunks both sides spell byte by byte; all of them is the usual case, and cheap to see."""
        want = [b" " + c.encode() for c in cut]
        sizes, whole = np.fromiter(map(len, want), np.int64, len(want)), b"".join(want)
        good = np.ones(len(cut), bool)
        for table, lengths, lists in ((self.a_bytes, self.a_sizes, a), (self.b_bytes, self.b_sizes, b)):
            ids, counts = _flat(lists)
            got = np.diff(np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(counts)])])
            if not np.array_equal(got, sizes) or b"".join(map(table.__getitem__, chain.from_iterable(lists))) != whole:
                good &= np.array([b"".join([table[i] for i in own]) == w for own, w in zip(lists, want)], bool)
        return good

    def entries(self, cut: list[str]) -> list[tuple | None]:
        """(tokens of A, of B, groups, links, groups as text, pairs, links of each pair) of each chunk, None where the bytes differ.

        All chunks are aligned in one go: their bytes lie one after the other.
        """
        out: list[tuple | None] = [None] * len(cut)
        a = [e.ids for e in self.byte_bpe.encode_batch_fast([" " + c for c in cut], add_special_tokens=False)]
        b = piece_ids(self.pieces, cut)
        good = np.flatnonzero(self._spelled(a, b, cut))
        if not len(good):
            return out
        if len(good) < len(cut):
            a, b = ([x[k] for k in good.tolist()] for x in (a, b))
        (a_ids, a_counts), (b_ids, b_counts) = _flat(a), _flat(b)
        to = terminals(np.cumsum(self.a_sizes[a_ids]), np.cumsum(self.b_sizes[b_ids]))
        ends = np.zeros(len(a_ids) + len(b_ids), bool)
        ends[to] = True  # terminals from left to right: groups in order
        label = (np.cumsum(ends) - 1)[to]
        a_group, b_group = label[: len(a_ids)], label[len(a_ids) :]
        m, n = (np.bincount(x, minlength=int(label[-1]) + 1) for x in (a_group, b_group))
        a_stop, b_stop, links = np.cumsum(m), np.cumsum(n), m * n

        # Text: the tokens in the order in which they are written, each with the mark behind it.
        written = np.empty(len(to), object)
        a_last, b_last = (np.r_[x[1:] != x[:-1], True] for x in (a_group, b_group))
        written[np.arange(len(a_ids)) + (b_stop - n)[a_group]] = self.a_text[2 * a_ids + a_last]
        written[np.arange(len(b_ids)) + a_stop[b_group]] = self.b_text[2 * b_ids + b_last]
        written = written.tolist()

        # Pairs: all of a group of few links, in order; the others by distinct ids.
        wide = links > PAIRED
        reps = np.where(wide, 0, n)[a_group]
        start = np.repeat((b_stop - n)[a_group], reps)
        step = np.arange(len(start)) - np.repeat(np.cumsum(reps) - reps, reps)
        pairs = (np.repeat(a_ids, reps) * self.span + b_ids[start + step]).tobytes()
        size = 8

        a_end, b_end = np.cumsum(a_counts), np.cumsum(b_counts)
        group_end = a_group[a_end - 1] + 1
        pair_end = np.cumsum(np.where(wide, 0, links))[group_end - 1] * size
        link_end = np.cumsum(links)[group_end - 1]
        late: dict[int, list[int]] = {}
        for g in np.flatnonzero(wide).tolist():
            late.setdefault(int(np.searchsorted(group_end, g, side="right")), []).append(g)
        ones = [np.ones(i, np.int64).tobytes() for i in range(PAIRED + 1)]  # shared by the entries
        token = group = pair = link = 0
        for k, (place, x, y, e, g, p, l) in enumerate(zip(good.tolist(), a_counts.tolist(), b_counts.tolist(), (a_end + b_end).tolist(), group_end.tolist(), pair_end.tolist(), link_end.tolist())):
            own = pairs[pair:p]
            held = (p - pair) // size
            times = ones[held] if held <= PAIRED else np.ones(held, np.int64).tobytes()
            for w in late.get(k, ()):
                more = group_pairs(a_ids[a_stop[w] - m[w] : a_stop[w]], b_ids[b_stop[w] - n[w] : b_stop[w]], self.span)
                own, times = own + more[0].tobytes(), times + more[1].tobytes()
            out[place] = (x, y, g - group, l - link, "".join(written[token:e])[:-1], own, times)
            token, group, pair, link = e, g, p, l
        return out


def _folded(pairs: bytes, times: bytes) -> tuple[bytes, bytes]:
    """Distinct pairs in order, their links added."""
    p, t = np.frombuffer(pairs, np.int64), np.frombuffer(times, np.int64)
    if not len(p):
        return b"", b""
    order = np.argsort(p, kind="stable")
    p = p[order]
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return p[first].tobytes(), np.add.reduceat(t[order], first).tobytes()


def aligned(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES) -> DataFrame:
    """(doc_id, row key, n_a, n_b, n_groups, n_links, groups, pairs, times) of every row.

    A is the byte-level tokenizer on a space and the text, B the piece model on the text. Byte
    offsets where tokens of both end cut the tokens into ``groups``, written as A ids, a bar and B
    ids, with semicolons between groups. ``pairs`` are the distinct linked ids (A id * size of B + B
    id), ``times`` the links that hold each.

    No token of either goes on over a single space between other characters, so a group lies in one
    chunk: each part of a task aligns its distinct chunks once, all in one array. Texts that are null, empty or hold U+2581, and any other whose
    tokens do not give back its bytes, have no tokens: zeros, and empty groups. A text without
    spaces is one chunk, however long. Repeated rows come as often as they are, a null doc_id stays null.
    """
    rows = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    fields = ["doc_id", *KEY, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, known = Aligner(byte_bpe, pieces), Table({}, TASK_ROWS)
        gc.disable()  # the many small entries hold no cycles, so there is nothing to look for among them
        try:
            for batch in batches:
                at = 0
                for group in grouped(t.decode("utf-8", "replace") for t in utf8(batch["text"])):
                    known.learn(group, aligner.entries)
                    sums, texts, pairs, times = [], [], [], []
                    for cut in group:
                        found = [known[c] for c in cut] if cut != [""] else []
                        if None in found:
                            found = []
                        a, b, groups, links, text, p, t = zip(*found) if found else [()] * 7
                        sums.append((sum(a), sum(b), sum(groups), sum(links)))
                        texts.append(";".join(text))
                        p, t = _folded(b"".join(p), b"".join(t))
                        pairs.append(p)
                        times.append(t)
                    own = [batch[c].slice(at, len(group)) for c in ("doc_id", *KEY)]
                    at += len(group)
                    numbers = [pa.array(x, pa.int64()) for x in zip(*sums)]
                    yield pa.RecordBatch.from_arrays([*own, *numbers, pa.array(texts, pa.string()), int_lists(pairs, np.int64), int_lists(times, np.int64)], fields)
        finally:
            known.clear()
            gc.enable()
            pa.default_memory_pool().release_unused()

    kinds = f"doc_id long, {FILE} long, {ROW} long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<bigint>, times array<bigint>"
    return rows.mapInArrow(run, kinds)


def pair_counts(rows: DataFrame, span: int) -> DataFrame:
    """(pair, count, best), stored: in how many rows the pair is linked, and whether its A id has none with more."""
    counts = write_table(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a = F.floor(F.col("pair") / span)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return write_table(counts.join(most, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-best")


def alignment(docs: DataFrame, byte_bpe: str = BYTE_BPE, pieces: str = PIECES, head_rows: int = HEAD_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    A pair's count is the number of rows of the corpus that hold it linked. ``n_best`` are the links
    whose pair has its A id's highest count (ties included), ``count_sum`` adds the counts of all links.

    The counts of the most frequent pairs, ``head_rows`` at most, are broadcast; a row's other
    pairs are rare by that choice, and meet their counts in a join. The split changes cost only.
    """
    span = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = write_table(aligned(docs, byte_bpe, pieces).select("doc_id", *KEY, "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times"), "aligned")
    counts = pair_counts(rows, span)
    often = F.broadcast(head(counts, "count", head_rows))  # at most head_rows rows of 17 bytes
    pairs = rows.select(*KEY, F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    met = pairs.join(often, "pair").unionByName(pairs.join(often, "pair", "left_anti").join(counts, "pair"))
    sums = met.groupBy(*KEY).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.drop("pairs", "times").join(sums, KEY, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


ship(cutting.__name__)
ship(__name__)
