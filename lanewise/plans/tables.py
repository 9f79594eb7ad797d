"""Shared intermediate tables of one application: loads, predictions, scored rows.

Each is written once to the shared folder and scanned afterwards, so a report costs one
pruned scan and a lost executor costs no recomputation of the joins behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.columns import with_targets
from lanewise.operators.analysis import annotate, join_predictions
from lanewise.operators.grouped_mean import GroupedMean
from lanewise.operators.quality import repair_weight
from lanewise.operators.splits import assign_folds, train_rows, validation_rows
from lanewise.schema import (
    DATE,
    HOLDOUT,
    ID,
    LOG_RPM,
    PREDICTIONS,
    RPM,
    STAR_FOLDS,
    STAR_HOLDOUT_START,
    STAR_SPLIT,
    TARGET,
)
from lanewise.session import write_table
from lanewise.sources.star import star_loads

_written: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of each input table: what was stored from others is not served again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in listed))


def once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], cluster_by: Sequence[str] = ()) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, input_state(spark, sf_dir), name)
    if key not in _written or _written[key].sparkSession is not spark:
        _written[key] = write_table(build(), name, list(cluster_by) or None)
    return _written[key]


def all_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every load as delivered, clustered by day; the id splits a hot day over many files.

    The joined rows are stored before they are clustered: ranges are found by a first look at
    the rows, which would run the joins twice.
    """
    return once(spark, sf_dir, "loads", lambda: write_table(star_loads(spark, sf_dir), "joined"), [DATE, ID])


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_loads(spark, sf_dir).where(F.col(DATE) < F.lit(STAR_HOLDOUT_START))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_loads(spark, sf_dir).where(F.col(DATE) >= F.lit(STAR_HOLDOUT_START)).select(*HOLDOUT.names)


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled loads with repaired weights and targets."""
    return with_targets(repair_weight(labelled(spark, sf_dir)))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train_rows(clean(spark, sf_dir), STAR_SPLIT)


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation_rows(clean(spark, sf_dir), STAR_SPLIT)


def priced(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Model output on the log scale -> predicted log, rate per mile and rate."""
    return df.withColumns(
        {
            "predicted_log_rate_per_mile": F.col(prediction),
            "predicted_rate_per_mile": F.exp(prediction),
            "predicted_rate": F.exp(prediction) * F.col("distance"),
        }
    )


def predictions_of(df: DataFrame) -> DataFrame:
    """The seven-column prediction layout from a priced, labelled frame."""
    return df.withColumns(
        {
            "actual_rate": F.col(TARGET),
            "actual_rate_per_mile": F.col(RPM),
            "actual_log_rate_per_mile": F.col(LOG_RPM),
        }
    ).select(*PREDICTIONS.names)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        model = GroupedMean().fit(train(spark, sf_dir))
        return predictions_of(priced(model.transform(validation(spark, sf_dir))))

    return once(spark, sf_dir, "predictions", build)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation loads joined one-to-one with the stored predictions, with error columns."""

    def build() -> DataFrame:
        loads = repair_weight(validation_rows(labelled(spark, sf_dir), STAR_SPLIT))
        return annotate(join_predictions(loads, predictions(spark, sf_dir)))

    return once(spark, sf_dir, "scored", build)


def fold_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced rows of every fold and role, not stored: a load occurs in several of them.

    All folds are fitted by one aggregate.
    """
    rows = assign_folds(clean(spark, sf_dir), STAR_FOLDS)
    model = GroupedMean(within=["fold"]).fit(rows.where("role = 'train'"))
    return priced(model.transform(rows)).select(
        "fold",
        "role",
        ID,
        F.col(TARGET).alias("actual_rate"),
        "predicted_rate",
        F.col(RPM).alias("actual_rate_per_mile"),
        "predicted_rate_per_mile",
    )


def fold_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled validation predictions of all folds."""

    def build() -> DataFrame:
        return fold_rows(spark, sf_dir).where("role = 'validation'").drop("role")

    return once(spark, sf_dir, "fold-predictions", build)
