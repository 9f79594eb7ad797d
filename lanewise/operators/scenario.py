"""A fixed load priced on every day of a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.quality import day_spine
from lanewise.schema import DATE, NUMERIC, SCENARIO_COLUMNS, Scenario


def scenario_inputs(loads: DataFrame, scenario: Scenario) -> DataFrame:
    """Model inputs for each day. Coordinates come from loads of the same city; what a scenario
    does not state stays missing, so the model's own imputation fills it."""
    ends = loads.agg(
        *[
            F.min(F.when(F.col(end) == getattr(scenario, end), F.col(f"{end}_{part}"))).alias(f"{end}_{part}")
            for end in ("pickup", "delivery")
            for part in ("lat", "lon")
        ]
    )
    fixed = {
        "pickup": F.lit(scenario.pickup),
        "delivery": F.lit(scenario.delivery),
        "distance": F.lit(scenario.distance),
        "equipment": F.lit(scenario.equipment),
        "weight": F.lit(scenario.weight),
    }
    known = {c: ends.select(c).scalar() for c in ends.columns}
    unknown = {c: F.lit(None).cast("double") for c in NUMERIC if c not in fixed and c not in known}
    days = day_spine(loads.sparkSession, scenario.first_day, scenario.last_day)
    return days.withColumnRenamed("day", DATE).withColumns(fixed | known | unknown)


def scenario_rates(inputs: DataFrame, model) -> DataFrame:
    """``model`` predicts the log rate per mile."""
    rate = F.exp("prediction") * F.col("distance")
    return model.transform(inputs).withColumn("predicted_rate", rate).select(*SCENARIO_COLUMNS)
