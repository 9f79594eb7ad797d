"""Substring dedup: hashed runs of consecutive sentences, joined over the whole corpus."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.pieces import SENTENCES, cut, split
from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.session import write_table

SENTENCES_IN_RUN = 2
WORDS_IN_RUN = 25
LONG_SENTENCE = 50
_LAST = (1 << 63) - 1


def shortest_runs(counts: list[int], sentences: int, words: int, long: int) -> list[tuple[int, int]]:
    """(first, number of sentences) of the shortest run that begins at each sentence."""
    out, last, total = [], 0, 0  # the run is [i, last), of total words
    for i in range(len(counts)):
        if counts[i] >= long:
            out.append((i, 1))
        else:
            while last < len(counts) and (last - i < sentences or total < words):
                total += counts[last]
                last += 1
            if last - i < sentences or total < words:
                break
            out.append((i, last - i))
        if last > i:
            total -= counts[i]
        else:
            last = i + 1
    out += [(i, 1) for i in range(out[-1][0] + 1 if out else 0, len(counts)) if counts[i] >= long]
    return out


def _hashed(text: bytes, between: re.Pattern) -> tuple[list[int], list[bytes]]:
    split_words = [text[a:b].lower().split() for a, b, _ in split(text, between)]
    return [len(w) for w in split_words], [xxhash.xxh3_128_digest(b" ".join(w)) for w in split_words]


def _digest(hashes: list[bytes], first: int, length: int) -> bytes:
    return hashes[first] if length == 1 else xxhash.xxh3_128_digest(b"".join(hashes[first : first + length]))


def runs(text: bytes, between: re.Pattern, sentences: int, words: int, long: int) -> list[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, 16-byte hash) of the run that begins at each sentence.

    A run is the shortest one with at least ``sentences`` sentences and ``words`` words; a
    sentence of ``long`` words is a run of its own. It depends on what it holds only, not on
    what surrounds it, so a repeated passage has the same runs wherever it stands. Words are
    compared without regard to the case of A-Z and to the blanks between them.
    """
    counts, hashes = _hashed(text, between)
    return [(i, n, _digest(hashes, i, n)) for i, n in shortest_runs(counts, sentences, words, long)]


def covering_runs(text: bytes, between: re.Pattern, sentences: int, words: int, long: int) -> list[tuple[int, int, bytes]]:
    """``runs`` and the shortest run that ends at each sentence, each place and length once.

    From a sentence of a repeated span either a run of the span begins, or too little of the
    span follows; then the run that ends with the span holds it. So they cover whole spans.
    """
    counts, hashes = _hashed(text, between)
    begun = shortest_runs(counts, sentences, words, long)
    ended = [(len(counts) - i - n, n) for i, n in shortest_runs(counts[::-1], sentences, words, long)]
    return [(i, n, _digest(hashes, i, n)) for i, n in sorted({*begun, *ended})]


def all_runs(docs: DataFrame, sentences: int, words: int, long: int) -> DataFrame:
    """Every run of every text, stored: (doc_id, row key, first, length, a, b), where a and b are the hash."""
    schema = pa.schema([("doc_id", pa.int64()), (FILE, pa.int64()), (ROW, pa.int64()), ("first", pa.int32()), ("length", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = re.compile(SENTENCES)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [covering_runs(t, between, sentences, words, long) for t in utf8(part["text"])]
                owner = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                flat = [r for f in found for r in f]
                halves = np.frombuffer(b"".join(h for _, _, h in flat), np.int64).reshape(-1, 2)
                columns = [part[c].take(owner) for c in ("doc_id", *KEY)] + [pa.array([r[k] for r in flat], pa.int32()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(halves[:, 0]), pa.array(halves[:, 1])], schema=schema)

    return write_table(docs.mapInArrow(work, f"doc_id long, {FILE} long, {ROW} long, first int, length int, a long, b long"), "runs")


def repeated_passages(
    docs: DataFrame, sentences: int = SENTENCES_IN_RUN, words: int = WORDS_IN_RUN, long: int = LONG_SENTENCE
) -> DataFrame:
    """(doc_id, row key, first_sentence, last_sentence, first_doc_ids) of each passage to remove.

    Runs are those of ``covering_runs``, so a repeated span of whole sentences goes to its last
    one. A run stays where it occurs first: smallest doc_id (null last), then row, then place. At
    any other place all its sentences go, and sentences that go one after the other are one
    passage. first_doc_ids are the documents where its runs occur first.

    Hashes are counted before they meet, so a passage in a third of all documents is one line
    for each task; the join that brings the first place back is one that Spark can split.
    Texts without such a run, null and empty ones among them, lose nothing; of repeated rows
    all but the first lose their runs. Extra columns are ignored.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    return _passages(all_runs(slim, sentences, words, long))


def _passages(found: DataFrame) -> DataFrame:
    order = F.coalesce("doc_id", F.lit(_LAST))
    # Stored, so that the join shuffles both sides and Spark can split a hash that very many texts share.
    counted = found.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(order).alias("first_doc")).where("n > 1").drop("n")
    repeated = write_table(counted, "counted")
    met = write_table(found.join(repeated, ["a", "b"]), "repeated")
    # Within the first document the first row and place stay; only that document's runs are compared.
    here = met.where(order == F.col("first_doc"))
    places = here.groupBy("a", "b").agg(F.min(F.struct(*KEY, "first", "length")).alias("place"))
    firsts = places.select(F.col("place.*")).withColumn("stays", F.lit(True))
    others = met.join(firsts, [*KEY, "first", "length"], "left").where("stays IS NULL")
    by_row = Window.partitionBy(*KEY).orderBy("first")
    end = F.col("first") + F.col("length")
    reached = F.max(end).over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    marked_starts = others.withColumn("end", end).withColumn("new", F.when(F.col("first") > F.coalesce(reached, F.lit(-1)), 1).otherwise(0))
    islands = marked_starts.withColumn("island", F.sum("new").over(by_row))
    source = F.when(F.col("first_doc") < _LAST, F.col("first_doc"))
    return islands.groupBy("doc_id", *KEY, "island").agg(
        F.min("first").alias("first_sentence"), (F.max("end") - 1).alias("last_sentence"), F.sort_array(F.collect_set(source)).alias("first_doc_ids")
    ).drop("island")


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, text, passages, removed_sentences, first_doc_ids, row key) of the documents that lose a passage.

    text is what is left. Documents that are not in the result stay as they are.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    passages = _passages(all_runs(slim, SENTENCES_IN_RUN, WORDS_IN_RUN, LONG_SENTENCE))
    per_row = write_table(
        passages.groupBy(*KEY).agg(
            F.flatten(F.collect_list(F.sequence("first_sentence", "last_sentence"))).alias("drop"),
            F.sort_array(F.collect_list(F.struct("first_sentence", "last_sentence"))).alias("passages"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("first_doc_ids")))).alias("first_doc_ids"),
        ),
        "passages",
    )
    rest = cut(slim, per_row, SENTENCES)
    facts = per_row.select(*KEY, "passages", F.size("drop").alias("removed_sentences"), "first_doc_ids")
    return rest.join(facts, KEY)


ship(__name__)
