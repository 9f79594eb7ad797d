"""Mixing sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.rows import FILE, KEY, ROW, WHOLE, counted, keyed, packed, row_counts, unpacked
from lanewise.session import write_table

WEIGHTS = (1, 2, 3)
EPOCHS = 3
SEED = "mix-1"
BUCKET_BITS = 16
_WORDS = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target): ``sizes`` is one row for each source.

    Sources by code point, null last, weigh ``weights`` in turn. Pouring the total size in
    proportion to the weights and resharing what exceeds a cap ends at one water level: with
    the sources in the order of cap / weight, each is full if its cap lies below the level
    that those before it leave. Windows run over one row for each source.
    """
    cap = F.col("source_size") * epochs
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("long")).withColumn("cap", cap)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upward = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    below = F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("total", F.sum("source_size").over(whole)).withColumn("level", (F.col("total") - below) / F.sum("weight").over(upward))
    full = levels.withColumn("full", F.col("cap") < F.col("weight") * F.col("level"))
    level = (F.col("total") - F.coalesce(F.sum(F.expr("if(full, cap, 0)")).over(whole), F.lit(0))) / F.sum(F.expr("if(full, 0, weight)")).over(whole)
    water = full.withColumn("water", level)
    target = F.expr("least(cast(cap as double), if(full, cast(cap as double), weight * water))")
    return water.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, copies, taken, row key.

    Every document is taken floor(target / source_size) times. What is still missing is taken
    once more from documents in the order of a seeded hash of doc_id and text, while they fit;
    then one document whose size is nearest to the rest, if it brings the sum closer. So a
    source misses its target by less than one document, at any size, and reruns agree.

    The order needs no sort of a whole source: sizes are summed over 65,536 ranges of the hash,
    the range in which the target falls is found from these sums, and only its documents are
    put in order. Null texts and texts without words have size 0; a source of size 0 has target
    0; null is a source of its own. Rows without a doc_id are spread by their texts; repeated rows count each. Extra columns are ignored; an
    empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(_WORDS)).cast("long")
    order = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce(F.col("text"), F.lit(""))))), 1, 15), 16, 10).cast("long")
    slim = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text")), "doc_id", "source", "text")
    rows = write_table(slim.select("doc_id", "source", size.alias("size"), order.alias("order"), *KEY), "sizes")

    bucket = F.shiftright("order", 60 - BUCKET_BITS).alias("bucket")
    sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("size"))
    targets = write_table(source_targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs), "targets")
    plan = targets.withColumn("whole", F.expr("if(source_size = 0, 0, cast(floor(target / source_size) as int))")).withColumn(
        "need", F.expr("target - cast(whole * source_size as double)")
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    through = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    same = F.col("plan_source").eqNullSafe(F.col("source"))
    # The first range that does not fit as a whole; without one, everything is taken.
    edges = (
        through.join(plan.select(F.col("source").alias("plan_source"), "need"), same)
        .where("before + size > need")
        .groupBy("source")
        .agg(F.min(F.struct("bucket", "before")).alias("edge"))
        .select(F.col("source").alias("edge_source"), F.col("edge.bucket").alias("edge"), F.col("edge.before").alias("edge_before"))
    )
    ruled = write_table(
        plan.withColumnRenamed("source", "plan_source").join(edges, F.col("plan_source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"), "plan"
    )
    joined = rows.join(ruled, same).drop("plan_source")
    sorted_edge = Window.partitionBy("source").orderBy("order", F.col("doc_id").asc_nulls_last(), *KEY)
    inner = joined.where(bucket == F.col("edge")).withColumn("sum", F.col("edge_before") + F.sum("size").over(sorted_edge.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    fits = inner.where("sum <= need").select(*[F.col(c).alias(f"fit_{c}") for c in KEY], F.col("sum").alias("fit_sum"))
    keys = (F.col(f"fit_{FILE}") == F.col(FILE)) & (F.col(f"fit_{ROW}") == F.col(ROW))
    edge_rows = joined.where(bucket == F.col("edge")).join(fits, keys, "left").withColumn("extra", F.col("fit_sum").isNotNull())
    other_rows = joined.where(F.col("edge").isNull() | (bucket != F.col("edge"))).withColumn("extra", F.col("edge").isNull() | (bucket < F.col("edge")))
    columns = ["doc_id", "source", "size", "order", "source_size", "target", "whole", "need", "extra", *KEY]
    first = write_table(edge_rows.select(*columns).unionAll(other_rows.select(*columns)), "prefix")

    taken = first.groupBy("source").agg(F.first("need").alias("need"), F.sum(F.expr("if(extra, size, 0)")).alias("got"))
    rest = taken.select(F.col("source").alias("rest_source"), (F.col("need") - F.col("got")).alias("rest"))
    nearness = F.struct(F.abs(F.col("size") - F.col("rest")).alias("off"), "order", F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    last = (
        first.where("NOT extra AND size > 0")
        .join(rest, F.col("rest_source").eqNullSafe(F.col("source")))
        .where("abs(size - rest) < rest")
        .groupBy("source")
        .agg(F.min(nearness).alias("best"))
        .select(*[F.col(f"best.{c}").alias(f"last_{c}") for c in KEY])
    )
    chosen = first.join(last, (F.col(f"last_{FILE}") == F.col(FILE)) & (F.col(f"last_{ROW}") == F.col(ROW)), "left")
    copies = F.col("whole") + ((F.col("extra") & (F.col("need") > 0)) | F.col(f"last_{ROW}").isNotNull()).cast("int")
    return chosen.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *KEY)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, with its columns, whatever their names."""
    rows = packed(docs, "doc_id", "source", "text")
    counts = row_counts(mix(rows.drop(WHOLE)).where("copies > 0"), "copies", EPOCHS)
    taken = counted(rows.select(WHOLE, *KEY), counts, "mix_copies").where("mix_copies > 0")
    return taken.select(WHOLE, F.explode(F.sequence(F.lit(1), "mix_copies"))).select(*unpacked(docs.columns))
