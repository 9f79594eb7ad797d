"""Texts as pieces (sentences or lines), and texts with some of their pieces cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import FILE, KEY, ROW, marked, row_bits, ship, utf8
from lanewise.session import write_table

#: What separates pieces; all in ASCII, so cuts never fall into a character.
SENTENCES = rb"(?<=[.!?])[ \t\r\x0b\x0c]+|\n+"
LINES = rb"\n+"


def split(text: bytes, between: re.Pattern) -> list[tuple[int, int, int]]:
    """(start, end, start of the next) of each piece that is not blank."""
    out, start = [], 0
    for gap in between.finditer(text):
        if not text[start : gap.start()].isspace() and gap.start() > start:
            out.append((start, gap.start(), gap.end()))
        start = gap.end()
    if text[start:].strip():
        out.append((start, len(text), len(text)))
    return out


def cut(docs: DataFrame, drops: DataFrame, pattern: bytes) -> DataFrame:
    """(doc_id, text, row key) of the rows of ``drops`` (row key, drop: array of piece numbers), without those pieces.

    Only the texts that lose something move, by the same join at every size: the drops grow
    with the texts, so they are no side to broadcast. A piece goes with the gap behind it.
    """
    stored = write_table(drops.select(*[F.col(c).alias(f"cut_{c}") for c in KEY], "drop"), "drops")
    touched = marked(docs, row_bits(stored.select(*[F.col(f"cut_{c}").alias(c) for c in KEY])), "cut_here").where("cut_here")
    joined = touched.join(stored.hint("merge"), (F.col(f"cut_{FILE}") == F.col(FILE)) & (F.col(f"cut_{ROW}") == F.col(ROW)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = re.compile(pattern)
        for batch in batches:
            texts = []
            for text, drop in zip(utf8(batch["text"]), batch["drop"].to_pylist()):
                parts, kept, at = split(text, between), [], 0
                for i in sorted(set(drop)):
                    kept.append(text[at : parts[i][0]])
                    at = parts[i][2]
                texts.append((b"".join(kept) + text[at:]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), batch[FILE], batch[ROW]], ["doc_id", "text", *KEY])

    return joined.select("doc_id", "text", *KEY, "drop").mapInArrow(run, f"doc_id long, text string, {FILE} long, {ROW} long")


ship(__name__)
