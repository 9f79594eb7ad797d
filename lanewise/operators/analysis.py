"""Error and residual reports on a scored table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.columns import bin_number, error_columns, quantile_bin, residual_columns, route
from lanewise.functions.quantiles import average_ranks, exact_quantiles, grouped_stats
from lanewise.functions.sizing import left_join
from lanewise.operators.quality import ContractError, reconcile_ids
from lanewise.schema import (
    CATEGORICAL,
    HIGH_RATE,
    ID,
    MIN_ROUTE_ROWS,
    QUANTILE_BINS,
    RPM,
    RPM_TAIL,
    TARGET,
    TOP_ROUTES,
    TOP_UNDERPREDICTED,
    WORST_ROWS,
    Bins,
)
from lanewise.session import write_table

RESIDUAL_INPUTS = ["distance", "weight", "market_index", "quote_signal", "actual_rate_per_mile"]


def join_predictions(loads: DataFrame, predictions: DataFrame) -> DataFrame:
    """Inner join on the load id, one-to-one and without loss; anything else is an error."""
    ids = reconcile_ids(predictions, loads).first()
    for counter in ("null_ids", "duplicate_ids", "duplicate_expected_ids", "missing_ids"):
        if ids[counter]:
            raise ContractError(f"predictions do not match the loads one to one: {counter}={ids[counter]}")
    return loads.join(predictions, ID)


def orphans(loads: DataFrame, predictions: DataFrame) -> DataFrame:
    """Loads without a prediction."""
    return loads.join(predictions.select(ID), ID, "left_anti")


def annotate(joined: DataFrame) -> DataFrame:
    return joined.withColumns(error_columns() | residual_columns() | {"route": route()})


def _error_stats(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return grouped_stats(
        df,
        by,
        [
            F.count("*").alias("rows"),
            F.avg("absolute_error").alias("mae"),
            F.sqrt(F.avg("squared_error")).alias("rmse"),
            F.avg("error").alias("mean_error"),
            F.avg("actual_rate").alias("actual_rate_mean"),
            F.avg("predicted_rate").alias("predicted_rate_mean"),
        ],
        {"median_error": ("error", 0.5)},
    )


def error_by(scored: DataFrame, column: str) -> DataFrame:
    """Error profile per value of ``column``, worst first; a missing value is a group."""
    return _error_stats(scored, [column]).orderBy(F.desc_nulls_last("mae"), column)


def error_by_bin(scored: DataFrame, bins: Bins) -> DataFrame:
    """Error profile per fixed bin. Empty bins are reported; unbinned rows only if there are any."""
    binned = scored.withColumn("bin", bin_number(bins))
    stats = _error_stats(binned, ["bin"])
    every = F.array(*[F.struct(F.lit(i).alias("b"), F.lit(name).alias("label")) for i, name in enumerate(bins.labels)])
    listed = scored.sparkSession.range(1).select(F.inline(every))
    # Both sides have one row per bin.
    joined = listed.join(F.broadcast(stats), F.col("b") == F.col("bin"), "full")
    return joined.select(
        F.coalesce("b", "bin").alias("bin"),
        "label",
        F.coalesce("rows", F.lit(0)).alias("rows"),
        *[c for c in stats.columns if c not in ("bin", "rows")],
    ).orderBy(F.desc_nulls_last("mae"), "bin")


def error_by_route(scored: DataFrame, min_rows: int = MIN_ROUTE_ROWS) -> DataFrame:
    """Routes with enough rows, worst first."""
    return (
        scored.groupBy("route")
        .agg(
            F.count("*").alias("rows"),
            F.avg("absolute_error").alias("mae"),
            F.sqrt(F.avg("squared_error")).alias("rmse"),
            F.avg("error").alias("mean_error"),
            F.avg("actual_rate").alias("actual_rate_mean"),
        )
        .where(F.col("rows") >= min_rows)
        .orderBy(F.desc_nulls_last("mae"), "route")
    )


def top_routes(scored: DataFrame, n: int = TOP_ROUTES, min_rows: int = MIN_ROUTE_ROWS) -> DataFrame:
    return error_by_route(scored, min_rows).limit(n)


def worst_predictions(scored: DataFrame, n: int = WORST_ROWS) -> DataFrame:
    columns = [
        ID,
        "pickup",
        "delivery",
        "equipment",
        "distance",
        "weight",
        "actual_rate",
        "predicted_rate",
        "error",
        "absolute_error",
    ]
    return scored.select(*columns).orderBy(F.desc("absolute_error"), ID).limit(n)


def error_contribution(scored: DataFrame) -> DataFrame:
    """Each row's share of the total squared and absolute error; the totals are scalar subqueries."""
    totals = scored.agg(F.sum("squared_error").alias("sq"), F.sum("absolute_error").alias("ab"))
    return scored.withColumns(
        {
            "error_squared_contribution": F.try_divide(F.col("squared_error"), totals.select("sq").scalar()),
            "absolute_error_contribution": F.try_divide(F.col("absolute_error"), totals.select("ab").scalar()),
        }
    )


def top_contributors(scored: DataFrame, n: int = WORST_ROWS) -> DataFrame:
    return error_contribution(scored).orderBy(F.desc("absolute_error"), ID).limit(n)


def top_underpredictions(scored: DataFrame, n: int = TOP_UNDERPREDICTED) -> DataFrame:
    columns = [
        ID,
        "pickup",
        "delivery",
        "equipment",
        "distance",
        "weight",
        "market_index",
        "quote_signal",
        "actual_rate",
        "predicted_rate",
        "actual_rate_per_mile",
        "predicted_rate_per_mile",
        "rpm_residual",
    ]
    return scored.select(*columns).orderBy(F.desc("rpm_residual"), ID).limit(n)


def residual_correlation(scored: DataFrame) -> DataFrame:
    """Pearson correlation of each numeric input with the residual, missing pairs left out."""
    columns = [*RESIDUAL_INPUTS, "rpm_residual"]
    row = scored.agg(*[F.corr(c, "rpm_residual").alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("correlation")) for c in columns]
    return row.select(F.inline(F.array(*entries))).orderBy("correlation", "column_name")


def _residual_stats() -> list:
    return [
        F.count("*").alias("rows"),
        F.avg("actual_rate_per_mile").alias("actual_rpm"),
        F.avg("predicted_rate_per_mile").alias("predicted_rpm"),
        F.avg("rpm_residual").alias("rpm_residual"),
        F.avg("absolute_rate_error").alias("mae"),
    ]


def quantile_edges(df: DataFrame, column: str, bins: int = QUANTILE_BINS) -> list[float]:
    """``bins + 1`` exact quantile edges; a handful of numbers, so they become literals."""
    row = exact_quantiles(df, column, [i / bins for i in range(bins + 1)]).first()
    return list(row["quantiles"]) if row and row["quantiles"] else []


def residuals_by_quantile(scored: DataFrame, column: str, bins: int = QUANTILE_BINS) -> DataFrame:
    """Residual profile per quantile bin; rows without a value are not binned."""
    edges = quantile_edges(scored, column, bins)
    stats = [*_residual_stats(), F.avg("actual_rate").alias("actual_rate")]
    if not edges:
        return scored.where(F.lit(False)).groupBy(F.lit(1).alias("bin")).agg(*stats)
    steps = sorted(set(edges))
    lower, upper = (F.array(*[F.lit(e) for e in side]) for side in (steps[:-1] or steps, steps[1:] or steps))
    return (
        scored.withColumn("bin", quantile_bin(column, edges))
        .where(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(*stats)
        .withColumns({"lower_edge": F.get(lower, F.col("bin") - 1), "upper_edge": F.get(upper, F.col("bin") - 1)})
        .orderBy("bin")
    )


def residuals_by(scored: DataFrame, column: str) -> DataFrame:
    return scored.where(F.col(column).isNotNull()).groupBy(column).agg(*_residual_stats()).orderBy(column)


def route_count(loads: DataFrame) -> DataFrame:
    return loads.agg(F.countDistinct(route()).alias("routes"))


def route_coverage(train: DataFrame, later: DataFrame) -> DataFrame:
    """Share of later loads whose route occurs in training. Both sides are folded per route first."""
    known = train.select(route().alias("route")).distinct().withColumn("known", F.lit(True))
    wanted = later.groupBy(route().alias("route")).agg(F.count("*").alias("n"))
    seen = F.coalesce("known", F.lit(False))
    return left_join(wanted, known, ["route"]).agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)).alias("known_rows"),
        F.try_divide(
            F.coalesce(F.sum(F.when(seen, F.col("n"))), F.lit(0)) * F.lit(100.0), F.sum("n")
        ).alias("known_pct"),
    )


def unseen_high_rate(train: DataFrame, later: DataFrame, threshold: float = HIGH_RATE) -> DataFrame:
    """High-rate later loads whose category was never seen in training, per categorical column."""

    def categories(df: DataFrame) -> DataFrame:
        entries = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("category")) for c in CATEGORICAL]
        return df.select(F.inline(F.array(*entries)))

    known = categories(train).distinct().withColumn("known", F.lit(True))
    high = categories(later.where(F.col(TARGET) > threshold)).groupBy("column_name", "category").agg(
        F.count("*").alias("n")
    )
    joined = left_join(high, known, ["column_name", "category"])
    return joined.groupBy("column_name").agg(
        F.sum("n").alias("high_rate_rows"),
        F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("unseen_rows"),
        F.count_if(F.col("known").isNull()).alias("unseen_categories"),
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Pairs are folded to counts, each column is ranked over its distinct values, and the mean
    of average ranks is (n + 1) / 2 on both sides.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count("*").alias("n"))
    pairs = write_table(pairs, "rank-pairs")  # read once per column and once for the result
    ranked = pairs
    for column, name in ((x, "rx"), (y, "ry")):
        counts = write_table(pairs.groupBy(column).agg(F.sum("n").alias("n")), "rank-counts")
        ranked = ranked.join(average_ranks(counts, column).withColumnRenamed("rank", name), column)
    total = pairs.agg(F.sum("n")).scalar()
    dx, dy = F.col("rx") - (total + 1) / 2.0, F.col("ry") - (total + 1) / 2.0
    n = F.col("n")
    return ranked.agg(
        F.sum("n").alias("rows"),
        F.try_divide(
            F.sum(n * dx * dy), F.sqrt(F.sum(n * dx * dx)) * F.sqrt(F.sum(n * dy * dy))
        ).alias("spearman"),
    )


def rpm_by_equipment(df: DataFrame) -> DataFrame:
    return df.groupBy("equipment").agg(F.count("*").alias("rows"), F.avg(RPM).alias("mean_rpm")).orderBy("equipment")


def rpm_tail(df: DataFrame) -> DataFrame:
    return grouped_stats(df.select(RPM), [], [F.count("*").alias("rows")], {a: (RPM, p) for a, p in RPM_TAIL.items()})
