"""How sources of one language differ in their words: exact divergences over hash-consed count trees."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lanewise.llm.rows import ship, utf8
from lanewise.session import write_table

LEAST_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
BLOCK = 8192  # leaves of one tree; a language's terms are dealt to as many trees as they need
CELLS = 1 << 22  # (source, leaf) cells of one block, and node pairs priced at once
SENT = 400_000  # (group, term) entries that a task holds before it sends them on
#: A-Z to a-z, other letters and all bytes from 0x80 as they are, the rest to blanks.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all documents, stored: occurrences and documents of each term in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict = defaultdict(Counter)
        within: dict = defaultdict(Counter)
        held = 0

        def send():
            for (lang, source), found in times.items():
                docs = within[lang, source]
                terms = list(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(terms), pa.string()),
                        pa.array([source] * len(terms), pa.string()),
                        pa.array([t.decode("utf-8", "replace") for t in terms], pa.string()),
                        pa.array(list(found.values()), pa.int64()),
                        pa.array([docs[t] for t in terms], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )

        for batch in batches:
            groups = list(zip(batch["lang"].to_pylist(), batch["source"].to_pylist()))
            for group, text in zip(groups, utf8(batch["text"])):
                words = text.translate(LETTERS).split()
                before = len(times[group])
                times[group].update(words)
                within[group].update(set(words))
                held += len(times[group]) - before
                if held > SENT:
                    yield from send()
                    times.clear()
                    within.clear()
                    held = 0
        yield from send()

    parts = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return write_table(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), in whole numbers at any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(count + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * kept)) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """The same share in 64-bit numbers: three digits to base 1000 by long division."""
    below = totals + 2 * kept
    rest, out = counts + 2, np.zeros(np.broadcast(counts, totals).shape, np.int64)
    whole, rest = np.divmod(rest, below)
    out += whole
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def forest(leaves: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Trees over the rows of ``leaves`` (a power of two wide) with equal subtrees stored once.

    Returns the distinct leaf counts, for each level from the bottom the children (left, right) of
    its distinct nodes, and each row's root.
    """
    counts, nodes = np.unique(leaves, return_inverse=True)
    nodes, levels = nodes.reshape(leaves.shape), []
    while nodes.shape[1] > 1:
        width = int(nodes.max()) + 1
        both, at = np.unique(nodes[:, 0::2].astype(np.int64) * width + nodes[:, 1::2], return_inverse=True)
        levels.append((both // width, both % width))
        nodes = at.reshape(len(leaves), -1)
    return counts, levels, nodes[:, 0]


def priced_pairs(leaves: np.ndarray, totals: np.ndarray, kept: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum over the leaves of floor((p - q)^2 / (p + q)) for each pair (a, b) of rows.

    Both trees are walked down together; of each pair of groups a pair of equal nodes is met once,
    and its price is handed to all places that hold it. A leaf of -1 is no term and costs nothing.
    """
    counts, levels, roots = forest(leaves)
    out = np.empty(len(a), np.int64)
    step = max(1, CELLS // leaves.shape[1])
    for start in range(0, len(a), step):
        pair = np.arange(start, min(start + step, len(a)))
        x, y, up = roots[a[pair]], roots[b[pair]], []
        for left, right in reversed(levels):
            width = max(int(left.max()), int(right.max())) + 1
            keys = [(np.concatenate([pair, pair]) - start) * width + np.concatenate([left[x], right[x]])]
            keys[0] = keys[0] * width + np.concatenate([left[y], right[y]])
            met, at = np.unique(keys[0], return_inverse=True)
            up.append(at.reshape(2, -1))
            pair, x, y = met // (width * width) + start, met // width % width, met % width
        p, q = shares(counts[x], totals[a[pair]], kept), shares(counts[y], totals[b[pair]], kept)
        price = np.where((counts[x] < 0) | (counts[y] < 0), 0, (p - q) * (p - q) // (p + q))
        for left, right in reversed(up):
            price = price[left] + price[right]
        out[start : start + len(price)] = price
    return out


def _pair_sums(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, other, value) for source < other of each language with kept terms."""
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = BLOCK
    while width > 64 and width * widest > CELLS:
        width //= 2
    cell = F.struct(F.pmod("number", F.lit(width)).cast("int").alias("at"), "source", "n")
    blocks = cells.groupBy("lang", F.floor(F.col("number") / width).alias("block")).agg(F.collect_list(cell).alias("cells"))
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("sources"), F.max("kept").alias("kept"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sources = batch["sources"][k].values
                names = sources.field("source")
                totals = sources.field("total").to_numpy()
                own = batch["cells"][k].values
                at = own.field("at").to_numpy()
                row = pa.compute.index_in(own.field("source"), names).to_numpy()
                terms = int(at.max()) + 1
                leaves = np.full((len(names), 1 << (terms - 1).bit_length()), -1, np.int64)
                leaves[:, at] = 0  # every kept term occurs somewhere
                leaves[row, at] = own.field("n").to_numpy()
                a, b = np.triu_indices(len(names), 1)
                price = priced_pairs(leaves, totals, batch["kept"][k].as_py(), a, b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["lang"][k].as_py()] * len(a), pa.string()), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(price)],
                    ["lang", "source", "other", "value"],
                )

    priced = blocks.join(lists, "lang").select("lang", "cells", "sources", "kept").mapInArrow(run, "lang string, source string, other string, value long")
    return priced.groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources are apart, and by which terms each one stands out.

    Terms are runs of ASCII letters (A-Z lower-cased) and characters from U+0080; each language
    keeps those in at least ``least_docs`` of its documents. A group (lang, source) and a language give
    each kept term a share of a billion, smoothed by 2; the gap of two shares p and q is
    floor((p - q)^2 / (p + q)). Part ``pair`` has every other source of the language with the gap
    summed over all kept terms; part ``term`` the ``top`` terms of the group whose share is above
    the language's. Ranks count from 1, larger values first, then the item's UTF-8 bytes.

    Kept terms are numbered by frequency and dealt to blocks of at most 8,192, and a block's counts of
    all sources form trees in which equal subtrees are one node; blocks add up in Spark. All
    arithmetic is exact. Null text, lang or source is an empty string; a group without
    terms takes part with zero counts; a language without kept terms has gaps of 0 and no
    part ``term``. Repeated rows count as often as they are; a language with one source has no
    part ``pair``; other columns are not read. An empty table gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    counted = term_counts(rows)
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    ordered = kept.repartitionByRange("lang", F.desc("all_n"), "term").sortWithinPartitions("lang", F.desc("all_n"), "term")
    terms = write_table(ordered.select("lang", "term", "all_n", F.monotonically_increasing_id().alias("number")), "kept-terms")
    cells = write_table(counted.drop("docs").join(terms, ["lang", "term"]), "cells")

    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("lang_total"))
    of_group = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = write_table(groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kept", "lang_total")]), "groups")

    half = _pair_sums(cells, groups)
    sums = half.unionAll(half.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    others = groups.select("lang", F.col("source").alias("other"))
    every = groups.select("lang", "source").join(others, "lang").where("source <> other")
    pairs = every.join(sums, ["lang", "source", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), F.coalesce("value", F.lit(0)).alias("value"))

    own, whole = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("all_n"), F.col("lang_total"), F.col("kept"))
    above = cells.join(groups, ["lang", "source"]).select("lang", "source", "term", own.alias("p"), whole.alias("q")).where("p > q")
    found = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return (
        pairs.withColumn("rank", F.row_number().over(order))
        .unionByName(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
        .select("lang", "source", "part", "item", "value", "rank")
    )


ship(__name__)
