"""Exact duplicates by an exchange of Golomb-coded fingerprints.

Tasks send sorted, coded fingerprints to owners; owners answer with one bit for each: seen
elsewhere or not. Only rows so marked, or seen twice in their own message, send their texts to
be grouped by their bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import FILE, KEY, ROW, keyed, marked, row_bits, ship, utf8
from lanewise.session import write_table

BLANKS = b" \t\n\x0b\x0c\r"
PRINT_BITS = 48
MESSAGE_ROWS = 16_384
OWNER_PRINTS = 131_072


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted, distinct unsigned values as Golomb-Rice coded gaps.

    Layout: count and remainder width k, then all quotients in unary (ones, closed by a zero),
    then all k-bit remainders; the two parts start at a byte, which lets both be read in bulk.
    """
    if not len(values):
        return struct.pack("<IB", 0, 0)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    mean = int(values[-1]) // len(values)
    k = max(mean.bit_length() - 1, 0)
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + len(values), np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
    remainders = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return struct.pack("<IB", len(values), k) + np.packbits(unary).tobytes() + np.packbits(remainders.ravel()).tobytes()


def golomb_decode(message: bytes) -> np.ndarray:
    count, k = struct.unpack_from("<IB", message)
    body = np.frombuffer(message, np.uint8, offset=5)
    if not count:
        return np.empty(0, np.uint64)
    tail = (count * k + 7) // 8
    zeros = np.flatnonzero(np.unpackbits(body[: len(body) - tail]) == 0)[:count]
    quotients = np.diff(zeros, prepend=-1) - 1
    bits = np.unpackbits(body[len(body) - tail :])[: count * k].reshape(count, k).astype(np.uint64)
    remainders = bits @ (np.uint64(1) << np.arange(k - 1, -1, -1, dtype=np.uint64)) if k else np.zeros(count, np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(k)) + remainders, dtype=np.uint64)


_SENT = pa.schema(
    [("message", pa.string()), ("owner", pa.int32()), ("coded", pa.binary())]
    + [(n, pa.list_(t)) for n, t in (("doc_id", pa.int64()), (FILE, pa.int64()), (ROW, pa.int64()), ("length", pa.int64()), ("sha", pa.binary()), ("rank", pa.int32()), ("twin", pa.bool_()))]
)
_SENT_DDL = (
    f"message string, owner int, coded binary, doc_id array<bigint>, {FILE} array<bigint>, {ROW} array<bigint>, "
    "length array<bigint>, sha array<binary>, rank array<int>, twin array<boolean>"
)


def _messages(part: pa.RecordBatch, owners: int) -> Iterator[dict]:
    """One message for each owner from at most MESSAGE_ROWS rows, in fingerprint order."""
    lengths, shas = [], []
    for text in utf8(part["text"]):
        lengths.append(len(text.decode("utf-8", "replace")))
        shas.append(hashlib.sha256(text.translate(None, BLANKS)).digest())
    prints = np.array([int.from_bytes(s[:8], "big") for s in shas], np.uint64) >> np.uint64(64 - PRINT_BITS)
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    owner = ((prints >> np.uint64(16)) * np.uint64(owners)) >> np.uint64(PRINT_BITS - 16)
    ids, files, rows = (part[c].take(pa.array(order)) for c in ("doc_id", FILE, ROW))
    for one in np.unique(owner):
        at = np.flatnonzero(owner == one)
        lo, hi = int(at[0]), int(at[-1]) + 1
        distinct, rank, count = np.unique(prints[lo:hi], return_inverse=True, return_counts=True)
        here = order[lo:hi]
        yield {
            "message": f"{files[lo]}:{rows[lo]}",  # a row is in one message only
            "owner": int(one),
            "coded": golomb_encode(distinct),
            "doc_id": ids[lo:hi].to_pylist(),
            FILE: files[lo:hi].to_pylist(),
            ROW: rows[lo:hi].to_pylist(),
            "length": [lengths[i] for i in here],
            "sha": [shas[i] for i in here],
            "rank": rank.tolist(),
            "twin": (count[rank] > 1).tolist(),
        }


def send(docs: DataFrame, owners: int) -> DataFrame:
    """Every task's messages with the rows behind them, stored; reads the texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MESSAGE_ROWS):
                yield pa.RecordBatch.from_pylist(list(_messages(batch.slice(at, MESSAGE_ROWS), owners)), _SENT)

    return write_table(docs.mapInArrow(run, _SENT_DDL), "sent")


def answers(sent: DataFrame) -> DataFrame:
    """Owners' bitmaps: for each message, which of its fingerprints other messages have too.

    An owner holds about OWNER_PRINTS fingerprints, since the number of owners follows the
    number of rows and a message names a fingerprint once, however many rows share it.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        decoded = [golomb_decode(m) for m in pdf["coded"]]
        values, counts = np.unique(np.concatenate(decoded), return_counts=True)
        shared = values[counts > 1]
        bitmaps = []
        for prints in decoded:
            bits = np.packbits(np.isin(prints, shared), bitorder="little").tobytes()
            bitmaps.append(np.frombuffer(bits + b"\0" * (-len(bits) % 8), np.int64).tolist())
        return pd.DataFrame({"message": pdf["message"], "owner": pdf["owner"], "bits": bitmaps})

    return sent.select("message", "owner", "coded").groupBy("owner").applyInPandas(run, "message string, owner int, bits array<bigint>")


def marked_rows(docs: DataFrame, owners: int) -> DataFrame:
    """Every row with its key, length, digest and whether it may have a duplicate, stored."""
    sent = send(docs, owners)
    fields = ["doc_id", *KEY, "length", "sha", "rank", "twin"]
    zipped = F.arrays_zip(*fields)
    answered = sent.join(answers(sent), ["message", "owner"]).select(
        F.inline(
            F.transform(
                zipped,
                lambda x: F.struct(
                    *[x[f].alias(f) for f in fields[:5]],
                    (x["twin"] | (F.getbit(F.get("bits", (x["rank"] / 64).cast("int")), x["rank"] % 64) == 1)).alias("suspect"),
                ),
            )
        )
    )
    return write_table(answered, "marked")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row key.

    Texts are equal if they are without the characters of ``[\\x20\\x09-\\x0D]``; null counts as
    empty, so null, empty and blank texts form one group. Of a group the row with the most code
    points in its original text stays, then the smallest doc_id (null last), then the first row:
    of repeated rows one stays. Extra columns are ignored; an empty table gives no rows.
    """
    slim = keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id", "text")
    owners = -(-slim.count() // OWNER_PRINTS) or 1
    rows = marked_rows(slim, owners)
    suspects = marked(slim, row_bits(rows.where("suspect")), "suspect").where("suspect")
    bare = F.translate(F.coalesce("text", F.lit("")), BLANKS.decode(), "")
    order = F.struct((-F.coalesce(F.char_length("text"), F.lit(0))).alias("size"), F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    by_bytes = suspects.select(bare.alias("bare"), order.alias("order")).groupBy(F.unhex(F.sha2("bare", 256)).alias("sha"), "bare").agg(
        F.min("order").alias("best"), F.count("*").alias("n")
    )
    # Each digest must stand for one text: the bytes decide, a digest alone never drops a row.
    groups = by_bytes.groupBy("sha").agg(F.min("best").alias("best"), F.sum("n").alias("n"), F.count("*").alias("texts"))
    checked = groups.select(
        "sha", "best", F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256"))).alias("n")
    )
    one = rows.where("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha", *KEY
    )
    same = (F.col(FILE) == F.col(f"best.{FILE}")) & (F.col(ROW) == F.col(f"best.{ROW}"))
    more = rows.where("suspect").join(checked, "sha").select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), same.alias("kept"), "sha", *KEY
    )
    return one.unionAll(more).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *KEY)


ship(__name__)
