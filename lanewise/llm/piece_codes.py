"""SentencePiece ids by a table of distinct chunks."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm import chunks as cutting
from lanewise.llm.chunks import Table, chunks, grouped, head, int_lists, piece_ids, pieces_of
from lanewise.llm.rows import ship, utf8
from lanewise.session import write_table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TABLE_ROWS, TABLE_BYTES = 1 << 17, 64  # of the corpus-wide table: chunks, bytes of a chunk
TASK_ROWS = 200_000  # further chunks that a task keeps
COUNTED = 400_000  # chunks that a task counts before it sends them on


def chunk_counts(texts: DataFrame) -> DataFrame:
    """(chunk, n): how often each short chunk occurs; one seen once in its part of a task is not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def send():
            often = [(c, n) for c, n in found.items() if n > 1 and len(c) <= TABLE_BYTES]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["chunk", "n"])

        for batch in batches:
            for text in utf8(batch["text"]):
                found.update(chunks(text.decode("utf-8", "replace")))
                if len(found) > COUNTED:
                    yield send()
                    found.clear()
        yield send()

    return texts.mapInArrow(run, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).where(F.octet_length("chunk") <= TABLE_BYTES)


def _entries(model, cut: list[str]) -> list[tuple[bytes, str]]:
    """Of each chunk its ids as int32 and the text they decode to."""
    ids = piece_ids(model, cut)
    return [(array("i", i).tobytes(), " " + text) for i, text in zip(ids, model.decode(ids))]


def piece_table(texts: DataFrame, model_file: str, rows: int) -> dict[str, tuple[bytes, str]]:
    """The corpus's most frequent chunks, segmented once in Spark; ``rows`` and the bytes of a chunk bound it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or pieces_of(model_file)
            cut = batch["chunk"].to_pylist()
            made = _entries(model, cut)
            yield pa.RecordBatch.from_arrays([batch["chunk"], pa.array([i for i, _ in made], pa.binary()), pa.array([t for _, t in made], pa.string())], ["chunk", "ids", "decoded"])

    often = head(write_table(chunk_counts(texts), "chunk-counts"), "n", rows).toArrow().column("chunk")
    if not len(often):
        return {}
    table = texts.sparkSession.createDataFrame(pa.table({"chunk": often})).mapInArrow(run, "chunk string, ids binary, decoded string").toArrow()
    return dict(zip(table["chunk"].to_pylist(), zip(table["ids"].to_pylist(), table["decoded"].to_pylist())))


def encoded(docs: DataFrame, model_file: str = MODEL, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(doc_id, ids: array<int>, decoded) of every row: what the library gives for the whole text.

    No piece goes on over a whitespace mark, so a text's ids are those of its chunks one after
    the other. The chunks frequent in the corpus are segmented once for all tasks and broadcast
    (at most ``table_rows`` chunks of 64 bytes); any other chunk is segmented once in each part
    of a task that meets it. Texts take their ids from these tables by the places of their chunks.
    The tables decide cost only. Texts do not move: besides counting chunks there is no shuffle.

    A null text is empty, an empty one has no ids and decodes to an empty text; a text without
    spaces is one chunk, however long. Repeated rows come as often as they are; a null doc_id
    stays null; other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = rows.sparkSession.sparkContext.broadcast(piece_table(rows.select("text"), model_file, table_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = pieces_of(model_file), Table(shared.value, TASK_ROWS)
        for batch in batches:
            at = 0
            for group in grouped(t.decode("utf-8", "replace") for t in utf8(batch["text"])):
                known.learn(group, lambda new: _entries(model, new))
                ids, texts = [], []
                for cut in group:
                    found = [known[c] for c in cut] if cut != [""] else []
                    ids.append(b"".join([f[0] for f in found]))
                    texts.append("".join([f[1] for f in found])[1:])
                part = batch["doc_id"].slice(at, len(group))
                at += len(group)
                yield pa.RecordBatch.from_arrays([part, int_lists(ids), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


ship(cutting.__name__)
ship(__name__)
