"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, overlap check.

The index holds the test items; every passage of every document is a query against it. Scores
are BM25 as a share of what the item scores against itself, so one threshold fits all items.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.session import write_table

K1, B = 1.2, 0.75
BLOCK = 4  # entries of a block
PART = 64  # words of an index entry at most, and the step between passages
PASSAGE = 2 * PART  # so a part lies in one passage as a whole
SHARD_BYTES = 16 << 20
SHINGLE = 5

_words = re.compile(r"\w+").findall


def words_of(text: bytes | str) -> list[str]:
    return _words((text.decode("utf-8", "replace") if isinstance(text, bytes) else text).lower())


@dataclass
class Index:
    """Postings of the entries, which are parts of items, with a bound for each term and block."""

    items: list[int]  # entry -> item
    texts: dict[int, tuple[list[str], list[str]]]  # item -> words of question, answer
    vocabulary: dict[str, int] = field(default_factory=dict)
    lists: list[dict[int, list[tuple[int, float]]]] = field(default_factory=list)  # term -> block -> (entry, share), by entry
    rare: np.ndarray = None  # term -> its blocks count in the first bound
    starts: np.ndarray = None  # term -> where its blocks start
    blocks: np.ndarray = None
    bounds: np.ndarray = None  # largest share of the term in that block
    rest: np.ndarray = None  # block -> what the frequent terms can add at most

    @property
    def n_blocks(self) -> int:
        return len(self.rest)


def item_words(question: str, answer: str) -> tuple[list[str], list[str]]:
    """Words of both parts; an item too short for a shingle is a question as a whole."""
    q, a = words_of(question), words_of(answer)
    return (q, a) if len(q) + len(a) >= SHINGLE else (q + a, [])


def entries_of(words: list[str]) -> list[list[str]]:
    """An item's words in entries of at most PART."""
    pieces = -(-len(words) // PART)
    return [words[len(words) * p // pieces : len(words) * (p + 1) // pieces] for p in range(pieces)]


def build_index(rows: list[tuple[int, str, str]], threshold: float, known: tuple[dict[str, int], int, float] | None = None) -> Index:
    """Index of (item_id, question, answer); items without words are left out.

    ``known`` has the entries of each term, all entries and their mean length, over the items
    of all shards; without it these rows are all there are.
    Terms of more than an eighth of the entries are frequent. Where they make up half the
    threshold of an entry, its weightiest ones count as rare, so that no entry can reach the
    threshold without a rare term.
    """
    texts = {i: item_words(q, a) for i, q, a in rows}
    parts = [(i, entry) for i in sorted(texts) for entry in entries_of(texts[i][0] + texts[i][1])]
    index = Index([i for i, _ in parts], texts)
    counts = [Counter(words) for _, words in parts]
    own_terms = Counter(t for c in counts for t in c)
    found, total, mean = known or (own_terms, len(parts), sum(len(w) for _, w in parts) / max(len(parts), 1))
    for t in sorted(own_terms):
        index.vocabulary[t] = len(index.vocabulary)
    postings: list[list[tuple[int, float]]] = [[] for _ in own_terms]
    for e, c in enumerate(counts):
        length = K1 * (1 - B + B * sum(c.values()) / mean)
        weight = {t: math.log(1 + (total - found[t] + 0.5) / (found[t] + 0.5)) * n * (K1 + 1) / (n + length) for t, n in c.items()}
        whole = sum(weight.values())
        for t, w in weight.items():
            postings[index.vocabulary[t]].append((e, w / whole))
    frequent = max(len(parts) / 8, 1)
    index.rare = np.array([len(p) <= frequent for p in postings] or [False])
    shares: list[list[tuple[float, int]]] = [[] for _ in parts]
    for t, posting in enumerate(postings):
        for e, s in posting:
            shares[e].append((s, t))
    for own in shares:
        common = sorted((x for x in own if not index.rare[x[1]]), reverse=True)
        while sum(s for s, _ in common) >= threshold / 2:
            index.rare[common.pop(0)[1]] = True
    rest = np.zeros(len(parts))
    starts, blocks, bounds = [0], [], []
    for t, posting in enumerate(postings):
        own: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for e, s in posting:
            own[e // BLOCK].append((e, s))
            if not index.rare[t]:
                rest[e] += s
        index.lists.append(dict(own))
        blocks += own
        bounds += (max(s for _, s in x) for x in own.values())
        starts.append(len(blocks))
    index.starts, index.blocks, index.bounds = np.array(starts), np.array(blocks, np.int64), np.array(bounds)
    index.rest = np.array([rest[b : b + BLOCK].max() for b in range(0, len(parts), BLOCK)])
    return index


def promising(index: Index, terms: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """(passage, block) whose bound reaches the threshold; ``terms`` has -1 for words outside the index.

    The bound is the sum of the block maxima of the passage's rare terms, plus the most that
    the frequent terms can add to any entry of the block.
    """
    at = np.flatnonzero(terms >= 0)
    at = at[index.rare[terms[at]]]
    if not len(at):
        return
    last = max(0, -(-(len(terms) - PASSAGE) // PART))  # number of the last passage
    cell, term = at // PART, terms[at].astype(np.int64)
    width = len(index.vocabulary)
    passages = np.concatenate([np.minimum(cell, last), np.clip(cell - 1, 0, last)])
    pairs = np.unique(passages * width + np.concatenate([term, term]))
    passage, term = pairs // width, pairs % width
    sizes = index.starts[term + 1] - index.starts[term]
    slots = np.repeat(index.starts[term] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    keys = np.repeat(passage, sizes) * index.n_blocks + index.blocks[slots]
    distinct, inverse = np.unique(keys, return_inverse=True)
    bound = np.bincount(inverse, weights=index.bounds[slots])
    good = distinct[bound + index.rest[distinct % index.n_blocks] >= threshold - 1e-9]
    for key in good.tolist():
        yield key // index.n_blocks, key % index.n_blocks


def wand(index: Index, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
    """Entries of the block with a score at or above the threshold, by pivoting over the lists.

    Lists are kept in the order of their current entry; the pivot is the first one at which the
    sum of bounds reaches the threshold, and lists before it jump there.
    """
    lists = [[own, 0, max(s for _, s in own)] for t in terms if (own := index.lists[t].get(block))]
    found = []
    while lists:
        lists.sort(key=lambda x: x[0][x[1]][0])
        total, pivot = 0.0, None
        for own, at, bound in lists:
            total += bound
            if total >= threshold - 1e-9:
                pivot = own[at][0]
                break
        if pivot is None:
            break
        if lists[0][0][lists[0][1]][0] == pivot:
            score = 0.0
            for x in lists:
                if x[0][x[1]][0] != pivot:
                    break
                score += x[0][x[1]][1]
                x[1] += 1
            if score >= threshold:
                found.append((pivot, score))
        else:
            for x in lists:
                while x[1] < len(x[0]) and x[0][x[1]][0] < pivot:
                    x[1] += 1
        lists = [x for x in lists if x[1] < len(x[0])]
    return found


def overlap(part: list[str], shingles: set[tuple[str, ...]], words: list[str], width: int = SHINGLE) -> float:
    """Share of the part's shingles that the document has; a shorter part counts as one shingle."""
    if not part:
        return 1.0
    if len(part) < width:
        n = len(part)
        return float(any(words[i : i + n] == part for i in range(len(words) - n + 1)))
    own = [tuple(part[i : i + width]) for i in range(len(part) - width + 1)]
    return sum(s in shingles for s in own) / len(own)


def search(index: Index, text: bytes, threshold: float, question: float, answer: float) -> list[dict]:
    """The items that ``text`` gives away: found by score, verified by the overlap of both parts."""
    words = words_of(text)
    get = index.vocabulary.get
    terms = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
    best: dict[int, tuple[float, int]] = {}
    inside, last = [], -1
    for passage, block in promising(index, terms, threshold):
        if passage != last:
            inside, last = list(set(terms[passage * PART : passage * PART + PASSAGE].tolist()) - {-1}), passage
        for entry, score in wand(index, inside, block, threshold):
            item = index.items[entry]
            if item not in best or score > best[item][0]:
                best[item] = (score, passage * PART)
    if not best:
        return []
    shingles = set(zip(*[words[i:] for i in range(SHINGLE)]))
    out = []
    for item, (score, at) in sorted(best.items()):
        q, a = (overlap(part, shingles, words) for part in index.texts[item])
        if q >= question and a >= answer:
            out.append({"item_id": item, "score": score, "first_word": at, "question_overlap": q, "answer_overlap": a})
    return out


def question_and_answer(text: Column) -> tuple[Column, Column]:
    """An item given as one text: its last sentence is the answer, all before it the question.

    A text of one sentence is a question without an answer.
    """
    split = r"(?s)^(.*[.!?\n])\s*(\S.*?)$"
    body = F.rtrim(text)
    question = F.regexp_extract(body, split, 1)
    return F.when(question == "", body).otherwise(question), F.regexp_extract(body, split, 2)


def term_counts(items: DataFrame) -> DataFrame:
    """(shard, term, entries, words): entries with the term; a null term counts all entries and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met: Counter = Counter()
            words: Counter = Counter()
            for shard, question, answer in zip(*(batch[c].to_pylist() for c in ("shard", "question", "answer"))):
                for entry in entries_of(sum(item_words(question, answer), [])):
                    met.update((shard, t) for t in set(entry))
                    met[shard, None] += 1
                    words[shard, None] += len(entry)
            out = [{"shard": s, "term": t, "entries": n, "words": words[s, t]} for (s, t), n in met.items()]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int64()), ("term", pa.string()), ("entries", pa.int64()), ("words", pa.int64())]))

    counted = items.select("shard", "question", "answer").mapInArrow(run, "shard long, term string, entries long, words long")
    return counted.groupBy("shard", "term").agg(F.sum("entries").alias("entries"), F.sum("words").alias("words"))


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.5, question: float = 0.8, answer: float = 0.5) -> DataFrame:
    """One row for each document and test item in it: (doc_id, item_id, score, first_word, overlaps, row key).

    ``items`` has item_id, question, answer. Every passage of 128 words, every 64 words, of
    every whole text is a query; all items at or above ``threshold`` are retrieved, and stay if
    shares ``question`` and ``answer`` of their five-word shingles occur in the document. The
    documents are scanned where they lie and nothing is shuffled. The index is broadcast in
    shards of a bounded size: more items mean more scans, never a larger broadcast. Frequencies
    and lengths are those of all items, so scores do not depend on the shards. Null and
    empty texts hold nothing. Of an item under five words, all words must follow each other in
    the document; items without words, null ones included, can't be found. Repeated rows are
    reported each. Extra columns are ignored.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    known = items.select(F.col("item_id").cast("long").alias("item_id"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("question", "answer")])
    known = known.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(F.struct("question", "answer")).alias("qa")).select("item_id", "qa.*")
    size = known.agg(F.sum(F.octet_length("question") + F.octet_length("answer") + 16)).first()[0] or 0
    shards = -(-size // SHARD_BYTES) or 1
    known = known.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)))
    counts = write_table(term_counts(known), "terms")
    entries, words = counts.where("term IS NULL").agg(F.sum("entries"), F.sum("words")).first()
    of_term = counts.where("term IS NOT NULL").groupBy("term").agg(F.sum("entries").alias("found"))
    found = []
    for shard in range(shards):
        own = F.col("shard") == shard
        rows = known.where(own).drop("shard").collect()
        terms = counts.where(own & F.col("term").isNotNull()).select("term").join(of_term, "term").toArrow()  # of SHARD_BYTES of text
        frequency = dict(zip(terms["term"].to_pylist(), terms["found"].to_pylist()))
        numbers = (frequency, entries or 0, (words or 0) / max(entries or 0, 1))
        index = docs.sparkSession.sparkContext.broadcast(vars(build_index([tuple(r) for r in rows], threshold, numbers)))
        found.append(_scan(slim, index, threshold, question, answer))
    return reduce(DataFrame.unionAll, found)


def _scan(slim: DataFrame, index, threshold: float, question: float, answer: float) -> DataFrame:
    names = [("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]
    schema = pa.schema([("doc_id", pa.int64()), (FILE, pa.int64()), (ROW, pa.int64()), *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Index(**index.value)
        for batch in batches:
            out = []
            if own.items:
                for i, text in enumerate(utf8(batch["text"])):
                    for hit in search(own, text, threshold, question, answer):
                        out.append({c: batch[c][i].as_py() for c in ("doc_id", *KEY)} | hit)
            yield pa.RecordBatch.from_pylist(out, schema)

    return slim.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, item_id long, score double, first_word long, question_overlap double, answer_overlap double")


def items_of(benchmark: DataFrame) -> DataFrame:
    question, answer = question_and_answer(F.col("text").cast("string"))
    return benchmark.select("item_id", question.alias("question"), answer.alias("answer"))


def leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Row keys of the documents that hold a test item, stored."""
    return write_table(leaks(docs, items_of(benchmark)).select(*KEY).distinct(), "leaked")


ship(__name__)
