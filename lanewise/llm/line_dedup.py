"""Line dedup by pairwise alignment: rare shared lines find the pairs, patience diff aligns them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.pieces import LINES, cut, split
from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.llm.sharding import numbered
from lanewise.llm.substring_dedup import shortest_runs
from lanewise.session import write_table

RARE = 4  # a line in so few different texts pairs all of them
ANCHOR_WORDS = 3
BLOCK_WORDS = 8


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j), rising in both: equal ends, then unique common lines, then between them."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        mine, other = Counter(a[i:i_end]), Counter(b[j:j_end])
        at = {x: k for k, x in enumerate(b[j:j_end], j) if other[x] == 1 and mine[x] == 1}
        common = [(k, at[x]) for k, x in enumerate(a[i:i_end], i) if x in at]
        if not common:
            continue
        # Longest rising run of partners: piles keep their least top, links lead back.
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for n, (_, partner) in enumerate(common):
            pile = bisect_left(tops, partner)
            back.append(piles[pile - 1] if pile else -1)
            tops[pile : pile + 1] = [partner]
            piles[pile : pile + 1] = [n]
        chain, n = [], piles[-1]
        while n >= 0:
            chain.append(common[n])
            n = back[n]
        for k, partner in reversed(chain):
            todo.append((i, k, j, partner))
            i, j = k, partner
        todo.append((i, i_end, j, j_end))
    return sorted(out)


def common_lines(later: list[int], earlier: list[int], words: list[int], smallest: int = BLOCK_WORDS) -> list[int]:
    """Lines of ``later`` in common blocks: runs aligned without a gap in either, of enough words."""
    drop, block, last = [], [], (-2, -2)
    for i, j in [*patience(later, earlier), (-1, -1)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= smallest:
                drop += block
            block = []
        block.append(i)
        last = (i, j)
    return drop


def block_keys(lines: list[int], words: list[int], smallest: int = BLOCK_WORDS) -> list[int]:
    """Hashes of the shortest runs of several lines with enough words that begin or that end at a line.

    A common block of several lines holds such a run at both ends, whatever its lines are, or
    a line that has the words alone; the runs and such lines cover the block.
    """
    begun = shortest_runs(words, 1, smallest, smallest)
    ended = [(len(words) - i - n, n) for i, n in shortest_runs(words[::-1], 1, smallest, smallest)]
    packed = np.array(lines, np.int64).tobytes()
    return sorted({xxhash.xxh64_intdigest(packed[8 * i : 8 * (i + n)], 1) - (1 << 63) for i, n in {*begun, *ended} if n > 1})


def line_table(docs: DataFrame) -> DataFrame:
    """Every row as its lines' hashes, word counts and block keys, numbered by doc_id (null last) and row; stored."""
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = re.compile(LINES)
        for batch in batches:
            whole, hashes, words, blocks = [], [], [], []
            for text in utf8(batch["text"]):
                lines = [text[a:b].split() for a, b, _ in split(text, between)]
                whole.append(xxhash.xxh3_128_digest(text))
                hashes.append([xxhash.xxh64_intdigest(b" ".join(w)) - (1 << 63) for w in lines])
                words.append([len(w) for w in lines])
                blocks.append(block_keys(hashes[-1], words[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch[FILE], batch[ROW], pa.array(whole, pa.binary()), pa.array(hashes, longs), pa.array(words, ints), pa.array(blocks, longs)],
                ["doc_id", *KEY, "whole", "lines", "words", "blocks"],
            )

    made = docs.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, whole binary, lines array<bigint>, words array<int>, blocks array<bigint>")
    kept = write_table(made.withColumn("no_id", F.col("doc_id").isNull()), "made")  # ranges are found by a first look at the rows
    return write_table(numbered(kept, ["no_id", "doc_id", *KEY]).drop("no_id"), "lines")


def candidate_pairs(texts: DataFrame) -> DataFrame:
    """(later, earlier), distinct, of different texts that share a line of at least ANCHOR_WORDS words or a block key.

    A line or key in at most RARE texts pairs all of them. A more common one pairs each text
    with the first that has it: so each run of lines with the words of a block meets the first
    text that holds the whole run, also if its lines are short or each of them stands first in
    another text. The number of pairs is linear in the lines, and every line that can be
    deleted is one that an earlier text keeps.
    """
    lines = texts.select("number", F.inline(F.arrays_zip("lines", "words"))).where(F.col("words") >= ANCHOR_WORDS).select("number", F.col("lines").alias("line"))
    each = lines.unionAll(texts.select("number", F.explode("blocks"))).distinct()
    shared = each.groupBy("line").agg(F.count("*").alias("n"), F.min("number").alias("first")).where("n > 1")
    # Stored, so that the join shuffles both sides and Spark can split a line that very many texts share.
    met = write_table(each.join(write_table(shared, "shared"), "line"), "anchors")
    star = met.where("number <> first").select(F.col("number").alias("later"), F.col("first").alias("earlier"))
    few = met.where(f"n > 2 AND n <= {RARE}").groupBy("line").agg(F.sort_array(F.collect_list("number")).alias("all"))
    rest = few.select("all", F.posexplode("all").alias("at", "later")).select("later", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("earlier"))
    return star.unionAll(rest).distinct()


def aligned(texts: DataFrame) -> DataFrame:
    """(later, earlier, drop): the pairs with a common block, and the later text's lines in such blocks."""
    pairs = write_table(candidate_pairs(texts), "pairs")
    later = texts.select(F.col("number").alias("later"), F.col("lines").alias("a"), "words")
    earlier = texts.select(F.col("number").alias("earlier"), F.col("lines").alias("b"))
    rows = pairs.join(later, "later").join(earlier, "earlier")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = [common_lines(*x) for x in zip(*(batch[c].to_pylist() for c in ("a", "b", "words")))]
            yield pa.RecordBatch.from_arrays([batch["later"], batch["earlier"], pa.array(drops, pa.list_(pa.int32()))], ["later", "earlier", "drop"])

    return rows.select("later", "earlier", "a", "b", "words").mapInArrow(run, "later long, earlier long, drop array<int>").where("size(drop) > 0")


def line_duplicates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is found, and the texts that change.

    The first frame has one row for each row of ``docs``: doc_id, class_id, links, lines,
    deleted_lines, row key. Rows of equal text are a class; its first row (smallest doc_id,
    null last) stands for it, and class_id is that row's doc_id. links counts the candidate
    classes (see candidate_pairs) that share a common block with it, earlier or later: of a
    line or run in more than RARE classes only links with its first holder count. Of a class's further rows
    every line is deleted; of the first row those in blocks common with an earlier class. A
    line stays in the first text that has it.

    The second frame has doc_id, text and row key of the rows that lose lines. Lines are
    compared without outer and repeated blanks; blank lines are no lines. Null and empty texts
    have none, form one class and no link. Extra columns are ignored.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    rows = line_table(slim)
    classes = write_table(rows.groupBy("whole").agg(F.min("number").alias("head")), "classes")
    firsts = rows.join(classes.select(F.col("head").alias("number")), "number", "left_semi").select("number", "doc_id", "lines", "words", "blocks")
    texts = write_table(firsts, "texts")
    found = write_table(aligned(texts), "aligned")
    drops = found.groupBy("later").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("drop")))).alias("drop"))
    links = found.select(F.col("later").alias("head")).unionAll(found.select("earlier")).groupBy("head").count()
    of_class = (
        texts.select(F.col("number").alias("head"), F.col("doc_id").alias("class_id"))
        .join(links.withColumnRenamed("count", "links"), "head", "left")
        .join(drops.withColumnRenamed("later", "head"), "head", "left")
    )
    heads = write_table(classes.join(of_class, "head"), "heads")
    joined = rows.join(heads, "whole")
    copy = F.when(F.size("lines") > 0, F.sequence(F.lit(0), F.size("lines") - 1)).otherwise(F.expr("array()").cast("array<int>"))
    every = F.when(F.col("number") != F.col("head"), copy).otherwise(F.coalesce("drop", F.expr("array()").cast("array<int>")))
    result = write_table(
        joined.select("doc_id", "class_id", F.coalesce("links", F.lit(0)).alias("links"), F.size("lines").alias("lines"), every.alias("drop"), *KEY), "result"
    )
    changed = cut(slim, result.where("size(drop) > 0"), LINES)
    return result.withColumn("deleted_lines", F.size("drop")).drop("drop"), changed


def line_dedup_rows(docs: DataFrame) -> DataFrame:
    """One row for each document with a digest of the text that is left, null where it is as before."""
    found, changed = line_duplicates(docs)
    digests = changed.select(F.crc32(F.col("text").cast("binary")).alias("rest_crc32"), F.octet_length("text").alias("rest_bytes"), *KEY)
    return found.join(digests, KEY, "left").select("doc_id", "class_id", "links", "lines", "deleted_lines", "rest_bytes", "rest_crc32")


ship(__name__)
