"""Deterministic reference model: mean log rate per mile of a group of training loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.functions.sizing import left_join
from lanewise.schema import LOG_RPM


class GroupedMean:
    """``exp(group mean of log rate per mile)``; an unseen group gets the overall mean."""

    def __init__(self, keys: Sequence[str] = ("equipment",), within: Sequence[str] = ()):
        self.keys, self.within = list(keys), list(within)

    def fit(self, train: DataFrame) -> "GroupedMeanModel":
        sums = train.groupBy(*self.within, *self.keys).agg(F.sum(LOG_RPM).alias("s"), F.count(LOG_RPM).alias("n"))
        groups = sums.select(*self.within, *self.keys, F.try_divide("s", "n").alias("group_mean"))
        overall = sums.groupBy(*self.within).agg(F.try_divide(F.sum("s"), F.sum("n")).alias("overall_mean"))
        return GroupedMeanModel(self.keys, self.within, groups, overall)


class GroupedMeanModel:
    def __init__(self, keys: list[str], within: list[str], groups: DataFrame, overall: DataFrame):
        self.keys, self.within, self.groups, self.overall = keys, within, groups, overall

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` on the log rate-per-mile scale."""
        out = left_join(df, self.groups, [*self.within, *self.keys])
        if self.within:
            out = left_join(out, self.overall, self.within)
        else:
            out = out.withColumn("overall_mean", self.overall.scalar())
        return out.withColumn("prediction", F.coalesce("group_mean", "overall_mean")).drop(
            "group_mean", "overall_mean"
        )
