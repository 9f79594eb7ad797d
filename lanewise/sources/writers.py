"""Sinks: predictions, submissions, report tables, fold results and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lanewise.schema import PREDICTIONS, SUBMISSION_COLUMNS


def write_predictions(df: DataFrame, path: str, width: int = 7, fmt: str = "parquet") -> None:
    """Write the first 3, 5 or 7 prediction columns."""
    if width not in (3, 5, 7):
        raise ValueError("width must be 3, 5 or 7")
    _save(df.select(*PREDICTIONS.names[:width]), path, fmt)


def write_submission(df: DataFrame, path: str) -> None:
    df.select(*SUBMISSION_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def write_reports(reports: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in reports.items():
        _save(df, f"{folder}/{name}", fmt)


def write_fold_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("fold").parquet(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """The run log is a growing table with one nested row per run."""
    runs.write.mode("append").json(path)


def _save(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
