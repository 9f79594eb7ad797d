"""Chronological splits and expanding folds, always half-open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.quality import ContractError
from lanewise.schema import DATE, Fold, Split


def train_rows(df: DataFrame, split: Split) -> DataFrame:
    return df.where(F.col(DATE) < F.lit(split.train_end))


def validation_rows(df: DataFrame, split: Split) -> DataFrame:
    return df.where((F.col(DATE) >= F.lit(split.train_end)) & (F.col(DATE) < F.lit(split.valid_end)))


def tagged(df: DataFrame, split: Split) -> DataFrame:
    """Both sides in one frame with a ``split`` column; rows after the window are left out."""
    side = F.when(F.col(DATE) < F.lit(split.train_end), "train").otherwise("validation")
    return df.where(F.col(DATE) < F.lit(split.valid_end)).withColumn("split", side)


def split_summary(df: DataFrame, split: Split) -> DataFrame:
    return tagged(df, split).groupBy("split").agg(
        F.count("*").alias("rows"), F.min(DATE).alias("first_day"), F.max(DATE).alias("last_day")
    )


def require_both_sides(df: DataFrame, split: Split) -> dict[str, dict]:
    """Summary per side; fails if a side is empty."""
    found = {r["split"]: r.asDict() for r in split_summary(df, split).collect()}
    for side in ("train", "validation"):
        if side not in found:
            raise ContractError(f"the {side} window is empty")
    return found


def assign_folds(df: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """One row per (row, fold, role). Windows may overlap, so a row may repeat across folds.

    The fold list is a literal array unnested per row: no join and no shuffle.
    """
    entries = []
    for f in folds:
        for role, a, b in (
            ("train", f.train_start, f.train_end),
            ("validation", f.valid_start, f.valid_end),
        ):
            inside = (F.col(DATE) >= F.lit(a)) & (F.col(DATE) < F.lit(b))
            entries.append(F.when(inside, F.struct(F.lit(f.name).alias("fold"), F.lit(role).alias("role"))))
    return (
        df.withColumn("__f", F.explode(F.array_compact(F.array(*entries))))
        .select(*df.columns, F.col("__f.fold").alias("fold"), F.col("__f.role").alias("role"))
    )
