"""Regression metrics, gaps, descriptions and fold statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.quantiles import grouped_stats
from lanewise.schema import ERROR_QUANTILES


def metric_columns(actual: str = "actual_rate", predicted: str = "predicted_rate") -> list[Column]:
    """MAE, RMSE and the coefficient of determination (not the squared correlation)."""
    error = F.col(predicted) - F.col(actual)
    total = F.regr_sxx(F.col(actual), F.col(actual))
    return [
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), total)).alias("r2"),
    ]


def regression_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return scored.groupBy(*by).agg(F.count("*").alias("rows"), *metric_columns())


def generalization_gap(metrics: DataFrame, side: str = "split", by: Sequence[str] = ()) -> DataFrame:
    """Metrics of both sides on one row plus gaps; R2 runs the other way round (train - validation)."""

    def pick(name: str, value: str) -> Column:
        return F.max(F.when(F.col(side) == value, F.col(name)))

    wide = metrics.groupBy(*by).agg(
        *[
            pick(m, s).alias(f"{s}_{m}")
            for s in ("train", "validation")
            for m in ("rows", "mae", "rmse", "r2")
        ]
    )
    return wide.withColumns(
        {
            "mae_gap": F.col("validation_mae") - F.col("train_mae"),
            "rmse_gap": F.col("validation_rmse") - F.col("train_rmse"),
            "r2_gap": F.col("train_r2") - F.col("validation_r2"),
        }
    )


def error_summary(scored: DataFrame) -> DataFrame:
    mae, rmse, _ = metric_columns()
    return grouped_stats(
        scored,
        [],
        [F.count("*").alias("rows"), mae, rmse, F.avg("error").alias("mean_signed_error")],
        {name: ("absolute_error", p) for name, p in ERROR_QUANTILES.items()},
    )


def describe(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of one column."""
    return grouped_stats(
        df.select(*by, column),
        by,
        [
            F.count(column).alias("count"),
            F.avg(column).alias("mean"),
            F.stddev_samp(column).alias("std"),
            F.min(column).alias("min"),
            F.max(column).alias("max"),
        ],
        {"q25": (column, 0.25), "median": (column, 0.5), "q75": (column, 0.75)},
    )


def prediction_summary(predictions: DataFrame, column: str = "predicted_rate") -> DataFrame:
    return grouped_stats(
        predictions.select(column),
        [],
        [
            F.count("*").alias("rows"),
            F.min(column).alias("min"),
            F.avg(column).alias("mean"),
            F.max(column).alias("max"),
        ],
        {"median": (column, 0.5)},
    )


def fold_statistics(fold_metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of the validation metrics over the folds."""
    spread = [
        column
        for m in ("mae", "rmse", "r2")
        for column in (
            F.avg(f"validation_{m}").alias(f"mean_validation_{m}"),
            F.stddev_samp(f"validation_{m}").alias(f"std_validation_{m}"),
        )
    ]
    return fold_metrics.agg(F.count("*").alias("folds"), *spread, F.avg("mae_gap").alias("mean_mae_gap"))


def column_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest and largest value per column, one row per column."""
    ends = df.agg(*[F.struct(F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max")).alias(c) for c in columns])
    entries = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.min"), F.col(f"{c}.max")) for c in columns]
    return ends.select(F.inline(F.array(*entries)))
