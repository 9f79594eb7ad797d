"""Sharding by a keyed permutation of global row numbers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.rows import KEY, WHOLE, keyed, packed, ship, unpacked
from lanewise.session import write_table

SHARDS = 16
KEYS = (104_729, 224_737, 350_377, 479_909, 611_953, 746_773)  # one for each Feistel round
PRIME = (1 << 31) - 1
FACTOR = 1_103_515_245


def half_bits(rows: int) -> int:
    """Bits of a half-word: the least h with 4**h >= rows, 1 at least."""
    return max(1, (max(rows - 1, 1).bit_length() + 1) // 2)


def _round(value: np.ndarray, key: int) -> np.ndarray:
    """Round function in 62-bit arithmetic, so that any engine with 64-bit integers can repeat it."""
    x = (value * FACTOR + key) % PRIME
    return (x * x + key) % PRIME


def permute(numbers: np.ndarray, rows: int, keys: tuple[int, ...] = KEYS) -> np.ndarray:
    """Where each row number in [0, rows) goes: Feistel rounds over 2h bits, repeated while outside."""
    return _walk(numbers, rows, lambda left, right, half: _forward(left, right, half, keys))


def restore(places: np.ndarray, rows: int, keys: tuple[int, ...] = KEYS) -> np.ndarray:
    """The inverse of ``permute``: which row number is at each place."""
    return _walk(places, rows, lambda left, right, half: _backward(left, right, half, keys))


def _forward(left, right, half, keys):
    for key in keys:
        left, right = right, left ^ (_round(right, key) & ((1 << half) - 1))
    return left, right


def _backward(left, right, half, keys):
    for key in reversed(keys):
        left, right = right ^ (_round(left, key) & ((1 << half) - 1)), left
    return left, right


def _walk(numbers: np.ndarray, rows: int, rounds) -> np.ndarray:
    half, out = half_bits(rows), np.array(numbers, np.int64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = rounds(out[open_] >> half, out[open_] & ((1 << half) - 1), half)
        out[open_] = (left << half) | right
        open_ = open_[out[open_] >= rows]
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with the long ``number``: 0, 1, ... in the order of ``order``, stored.

    Ranges are sorted by their own tasks; only their row counts, one for each range, meet. The
    last column of ``order`` should be unique, so that no value fills a range on its own.
    """
    at = F.monotonically_increasing_id()
    parts = write_table(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number_at", at), "ranges")
    part, within = F.shiftright("number_at", 33), F.col("number_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = parts.groupBy(part.alias("number_part")).count()
    start = F.coalesce(F.sum("count").over(Window.orderBy("number_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("number_part", start.alias("number_start"))
    return parts.join(starts, part == F.col("number_part")).withColumn("number", F.col("number_start") + within).drop("number_at", "number_part", "number_start")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, number, place, shard, slot, row key.

    Rows are numbered by doc_id (null last), then text_crc32, size and the row itself. The
    number's place under the permutation gives shard = place mod ``shards`` and slot = place div
    ``shards``: counts differ by one at most, slots have no gaps, and (shard, slot) leads back
    to the number by ``restore``. The place depends on the number and the number of rows only,
    so reruns agree; of repeated rows it is open which gets which place. Null text has no
    bytes: size 1, text_crc32 0. Extra columns are ignored; an empty table gives no rows.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", "text")
    text, total = F.coalesce("text", F.lit("")), slim.count()
    sized = slim.select(
        F.col("doc_id").isNull().alias("no_id"),
        "doc_id",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        *KEY,
    )
    rows = numbered(sized, sized.columns)

    @F.pandas_udf("long")
    def place(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in numbers:
            yield pd.Series(permute(part.to_numpy(), total))

    return rows.withColumn("place", place("number")).select(
        "doc_id",
        "size",
        "text_crc32",
        "number",
        "place",
        (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"),
        *KEY,
    )


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with all its columns, then shard and slot; own columns of these names are replaced."""
    rows = packed(docs, "doc_id", "text")
    places = shard(rows.drop(WHOLE), shards).select(*[F.col(c).alias(f"shard_{c}") for c in KEY], "shard", "slot")
    joined = rows.select(WHOLE, *KEY).join(places, reduce(and_, (F.col(f"shard_{c}") == F.col(c) for c in KEY)))
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return joined.select(*unpacked(kept), "shard", "slot")


def shard_rows(docs: DataFrame) -> DataFrame:
    """The contract's columns, under the law of equal row counts."""
    return shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


ship(__name__)
