"""Row keys, row marks and text buffers shared by the corpus operators."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.session import write_table

FILE, ROW = "lanewise_file", "lanewise_row"
KEY = [FILE, ROW]
_BLOCK, _BITS = "lanewise_block", "lanewise_bits"
WHOLE = "lanewise_row_as_given"
TEXT_ROWS = 1_000  # rows with texts in one Arrow batch; both the JVM and Python hold a batch or more of each task
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_SCAN_NODES = {"Project", "Filter", "Relation", "SubqueryAlias", "View"}


def ship(module: str) -> None:
    """Send this module's functions with the closures: executors need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def _is_scan(docs: DataFrame) -> bool:
    """Only projections and filters over one file scan: then file and row number name a row."""
    lines = docs._jdf.queryExecution().analyzed().toString().splitlines()
    nodes = [line.lstrip(" +-:").split(" ")[0].split("[")[0] for line in lines if line.strip()]
    return set(nodes) <= _SCAN_NODES and nodes.count("Relation") == 1


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs`` with a stable, unique key of each row.

    The key is (hash of the file's path, row number in the file), so two passes over the same
    table agree whatever the splits. A frame that is no plain parquet scan is written first;
    whoever needs its keys twice keys it once and goes on from the result.
    """
    number = [F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)]
    if "_metadata" not in docs.columns and _is_scan(docs):
        try:
            return docs.select(*columns, *number)
        except AnalysisException:
            pass
    return write_table(docs.select(*columns), "rows").select(*columns, *number)


def row_counts(rows: DataFrame, count: str, most: int) -> DataFrame:
    """What ``count`` gives for the given row keys, 1 to ``most``, as one 64-bit mark for each binary digit and 64 rows of a file; stored.

    16 bytes and 8 for each digit for 64 rows at most: while the table is below the broadcast
    threshold Spark broadcasts it, beyond that the join on (file, block) shuffles.
    """
    block = F.shiftright(ROW, 6)
    bit = f"shiftleft(1L, cast({ROW} % 64 as int))"
    marks = [F.bit_or(F.expr(f"if(getbit(cast({count} as long), {i}) = 1, {bit}, 0L)")).alias(f"{_BITS}_{i}") for i in range(most.bit_length())]
    return write_table(rows.groupBy(F.col(FILE), block.alias(_BLOCK)).agg(*marks), "bits")


def counted(docs: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """``docs`` (keyed) with the int ``name``: the count that ``row_counts`` has of the row, or else 0."""
    block = F.shiftright(docs[ROW], 6)
    joined = docs.join(counts.withColumnRenamed(FILE, "lanewise_other"), (F.col("lanewise_other") == docs[FILE]) & (F.col(_BLOCK) == block), "left")
    marks = [c for c in counts.columns if c.startswith(f"{_BITS}_")]
    digits = " + ".join(f"shiftleft(cast(coalesce(getbit({c}, cast({ROW} % 64 as int)), 0) as int), {i})" for i, c in enumerate(marks))
    return joined.withColumn(name, F.expr(digits)).drop("lanewise_other", _BLOCK, *marks)


def row_bits(rows: DataFrame) -> DataFrame:
    """The given row keys as one 64-bit mark for each 64 rows of a file, stored."""
    return row_counts(rows, "1", 1)


def marked(docs: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """``docs`` (keyed) with the boolean ``name``: its row is among those of ``bits``."""
    return counted(docs, bits, name).withColumn(name, F.col(name) == 1)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside passes texts to Python in batches of at most TEXT_ROWS rows."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= TEXT_ROWS:
        spark.conf.set(_BATCH, str(TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` of ``docs``, the whole row as the struct WHOLE, and the row's key.

    Inside the struct the caller's columns may have any name, also one that is used here.
    """
    frame = docs.select(F.struct(*map(_quoted, docs.columns)).alias(WHOLE), *columns)
    if any(c.lower() == "_metadata" for c in docs.columns):
        frame = write_table(frame, "rows")
    return keyed(frame, WHOLE, *columns)


def unpacked(columns: list[str]) -> list[Column]:
    """These columns of the packed row."""
    return [F.col(WHOLE).getField(c).alias(c) for c in columns]


def without(docs: DataFrame, pick) -> DataFrame:
    """``docs`` less the rows whose keys ``pick`` selects; every column is kept as it is, whatever its name.

    ``pick`` gets doc_id, text and key of the rows and returns the keys to drop.
    """
    rows = packed(docs, "doc_id", "text")
    bits = row_bits(pick(rows.drop(WHOLE)))
    return marked(rows.select(WHOLE, *KEY), bits, "lanewise_drop").where("NOT lanewise_drop").select(*unpacked(docs.columns))


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``write_table`` stored, once all that reads them is stored itself."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            if f"/{context.applicationId}/" in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def utf8(column: pa.Array) -> Iterator[bytes]:
    """Each value's bytes, one at a time; null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    nulls = column.is_null().to_pylist() if column.null_count else None
    for i in range(len(column)):
        yield b"" if nulls and nulls[i] else bytes(whole[ends[i] : ends[i + 1]])


ship(__name__)
