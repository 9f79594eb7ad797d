"""Queries op1 to op13: each applies its operator to its whole table and returns all of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.alignment import alignment
from lanewise.llm.decontaminate import items_of, leaks
from lanewise.llm.divergence import divergence
from lanewise.llm.exact_dedup import exact_duplicates
from lanewise.llm.line_dedup import line_dedup_rows
from lanewise.llm.mixing import mix
from lanewise.llm.piece_codes import encoded
from lanewise.llm.quality import quality_rows
from lanewise.llm.sharding import shard_rows
from lanewise.llm.simhash import near_duplicate_rows
from lanewise.llm.substring_dedup import deduplicated
from lanewise.llm.toxicity import toxic_rows
from lanewise.llm.warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that loses a passage; the others stay as they are."""
    lost = deduplicated(_table(spark, sf_dir, "documents"))
    digest = F.sha2("text", 256).alias("rest_sha256")
    return lost.select("doc_id", "first_doc_ids", F.size("passages").alias("passages"), "removed_sentences", F.octet_length("text").alias("rest_bytes"), digest)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_rows(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_rows(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_rows(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(_table(spark, sf_dir, "documents"), items_of(_table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "item_id", "score", "first_word", "question_overlap", "answer_overlap")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(_table(spark, sf_dir, "documents"))
    digests = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256), F.sha2("decoded", 256)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digests[0].alias("ids_sha256"), digests[1].alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_warc,
        op3_quality,
        op4_line_dedup,
        op5_mixing,
        op6_toxicity,
        op7_simhash,
        op8_sharding,
        op9_exact_dedup,
        op10_decontamination,
        op11_token_alignment,
        op12_source_divergence,
        op13_sentencepiece,
    )
}
