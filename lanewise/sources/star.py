"""The ``loads`` table derived from the star-schema tables (orders, lineitem, part, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.schema import LOADS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _every(key: Column, n: int) -> Column:
    return key % F.lit(n) == 0


def star_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One load per order with lines.

    Lines are aggregated before the join, so an order with very many lines is folded on the
    map side. The dimension joins are plain equi-joins: Spark broadcasts a side only when its
    file size is under the session's threshold.
    """
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_suppkey").alias("s_suppkey"),
            F.min("l_partkey").alias("p_partkey"),
            F.sum("l_quantity").alias("qty"),
            (F.min("l_discount") + F.lit(0.0)).alias("disc"),
        )
        .withColumnRenamed("l_orderkey", "o_orderkey")
    )
    nation = table(spark, sf_dir, "nation")
    origin = table(spark, sf_dir, "supplier").join(
        nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin_city")),
        "s_nationkey",
    )
    destination = table(spark, sf_dir, "customer").join(
        nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("delivery")),
        "c_nationkey",
    )
    joined = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate")
        .join(lines, "o_orderkey")
        .join(origin.select("s_suppkey", "s_nationkey", "origin_city"), "s_suppkey")
        .join(destination.select("c_custkey", "c_nationkey", "delivery"), "c_custkey")
        .join(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey")
    )
    k = F.col("o_orderkey")
    van = F.col("p_size") % 3
    distance = (50 + 10 * ((k * 37) % 251)).cast("double")
    gross = 150 * F.col("qty")
    rpm = F.lit(1.6) + F.lit(0.2) * van + F.col("o_totalprice") / F.lit(250000.0)
    loads = joined.select(
        F.concat(F.lit("LD-"), F.lpad(k.cast("string"), 8, "0")).alias("load_id"),
        F.when(~_every(k, 211), F.col("origin_city")).alias("pickup"),
        F.col("delivery"),
        (25 + F.col("s_nationkey")).cast("double").alias("pickup_lat"),
        (-120 + 2 * F.col("s_nationkey")).cast("double").alias("pickup_lon"),
        (25 + F.col("c_nationkey")).cast("double").alias("delivery_lat"),
        (-120 + 2 * F.col("c_nationkey")).cast("double").alias("delivery_lon"),
        distance.alias("distance"),
        F.when(van == 0, "Dry Van").when(van == 1, "Flatbed").otherwise("Reefer").alias("equipment"),
        F.when(_every(k, 160), -gross).when(~_every(k, 161), gross).alias("weight"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(~_every(k, 131), (90 + (k * 13) % 21).cast("double")).alias("market_index"),
        F.col("disc").alias("quote_signal"),
        (distance * rpm * F.when(_every(k, 97), 4).otherwise(1)).alias("posted_rate"),
    )
    return loads.select(*[F.col(f.name).cast(f.dataType) for f in LOADS.fields])
