"""SimHash near-duplicates by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.components import components
from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.session import write_table

SEED = 42
_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for a text without words."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes)
        starts = (ends - sizes)[: len(words) - width + 1].tolist()
        stops = (ends - 1)[width - 1 :].tolist()
        flat, digest = b" ".join(words), xxhash.xxh64_intdigest
        hashes = [digest(flat[a:b], SEED) for a, b in zip(starts, stops)]
    octets = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ _BIT_OF_BYTE for i in range(8)])
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint as signed long, row key) of every row, stored; reads texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in utf8(batch["text"])), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch[FILE], batch[ROW], pa.array(prints.view(np.int64))], ["doc_id", *KEY, "print"])

    rows = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", "text")
    return write_table(rows.mapInArrow(run, f"doc_id long, {FILE} long, {ROW} long, print long"), "prints")


def block_masks(count: int, distance: int) -> list[int]:
    """Masks, as signed longs, one of which two prints within ``distance`` bits must agree on.

    The 64 bits fall into b blocks; at most ``distance`` of them differ, so b - distance are
    equal. Every such choice of blocks is a mask. b is the least number for which a mask has
    log2(count) bits, so a print meets about one unrelated print for each mask at any size.
    The choice changes cost only: for every b no pair is missed.
    """
    for blocks in range(distance + 1, 17):
        bounds = [64 * i // blocks for i in range(blocks + 1)]
        parts = [sum(1 << bit for bit in range(lo, hi)) for lo, hi in zip(bounds, bounds[1:])]
        masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
        if min(m.bit_count() for m in masks) >= max(count, 1).bit_length():
            break
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keys(prints: DataFrame, masks: list[int]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])
    return prints.select("*", F.inline(each))


def print_components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(print, root): fingerprints linked directly or in steps by at most ``distance`` bits.

    Works on distinct fingerprints, weighted by their documents. First each block's most
    frequent print is a hub and takes the prints within the distance, which folds large groups
    of near copies in a number of rows linear in the group. Then only blocks that still hold
    different components are joined, and only pairs of different components that pass the
    distance check come out of the join. No pair within the distance is left out.
    """
    distinct = write_table(prints.groupBy("print").agg(F.count("*").alias("weight")), "distinct")
    masks = block_masks(distinct.count(), distance)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance

    keys = _keys(distinct, masks)
    hubs = keys.groupBy("mask", "block").agg(F.max_by("print", "weight").alias("b"), F.count("*").alias("n")).where("n > 1")
    hubs = write_table(hubs, "print-hubs")
    # A print has many keys, which Spark does not see: it would broadcast those of a small table of prints.
    spokes = keys.select("mask", "block", F.col("print").alias("a")).hint("merge").join(hubs, ["mask", "block"]).where((F.col("a") != F.col("b")) & close)
    folded = components(spokes.select("a", "b"))
    rooted = write_table(_rooted(distinct.select("print"), folded), "folded")

    keys = _keys(rooted, masks)
    mixed = keys.groupBy("mask", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("mask", "block")
    active = write_table(keys.join(mixed, ["mask", "block"], "left_semi"), "active")
    left = active.select("mask", "block", F.col("print").alias("a"), F.col("root").alias("ra"))
    right = active.select("mask", "block", F.col("print").alias("b"), F.col("root").alias("rb"))
    same = (left["mask"] == right["mask"]) & (left["block"] == right["block"])
    pairs = left.join(right, same & (F.col("ra") < F.col("rb")) & close)
    joined = components(pairs.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    final = joined.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return rooted.join(final, "root", "left").select("print", F.coalesce("top", "root").alias("root"))


def _rooted(nodes: DataFrame, found: DataFrame) -> DataFrame:
    roots = found.select(F.col("node").alias("print"), "root")
    return nodes.join(roots, "print", "left").select("print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, first, row key) for every row of ``docs``.

    component_id is the smallest doc_id that can be reached; null doc_ids count last, and a
    component without any doc_id has null. ``first`` marks the one row that stands for its
    component: smallest doc_id, then row key, so of repeated rows one is first. Null and empty
    texts have fingerprint zero and are linked like others. Extra columns are ignored.
    """
    rows = fingerprints(docs, width)
    roots = print_components(rows, distance)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    of_print = rows.groupBy("print").agg(F.min(order).alias("best"))
    linked = of_print.join(roots, "print")
    heads = linked.groupBy("root").agg(F.min("best").alias("head"))
    groups = linked.select("print", "root").join(heads, "root").select("print", F.col("head.doc_id").alias("component_id"), F.col("head").alias("head"))
    first = (F.col(FILE) == F.col(f"head.{FILE}")) & (F.col(ROW) == F.col(f"head.{ROW}"))
    return rows.join(groups, "print").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        first.alias("first"),
        *KEY,
    )


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return near_duplicates(docs).select("doc_id", "fingerprint", "component_id")


ship(__name__)
